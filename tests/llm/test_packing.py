import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brinegrid.llm import packing as P
from brinegrid.llm.tokens import byte_lengths, default_path, encoding


def spread(plan):
    """Every item of a plan: (length, rank, container, offset)."""
    for n, a, z, box, per, off, _ in plan:
        for k in range(z - a):
            yield n, a + k, box + k // per, off + (k % per) * n


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_a_packing(seed):
    r = random.Random(seed)
    hist = {r.randrange(1, 2049): r.choice([1, 2, 7, 500]) for _ in range(r.choice([1, 3, 40, 300]))}
    plan = P.plan_containers(hist)
    items = list(spread(plan))
    assert Counter(n for n, *_ in items) == hist
    assert all(sorted(x[1] for x in items if x[0] == n) == list(range(c)) for n, c in hist.items())
    boxes = defaultdict(list)
    for n, _, box, off in items:
        boxes[box].append((off, n))
    assert sorted(boxes) == list(range(len(boxes)))
    for used in boxes.values():
        at = 0
        for off, n in sorted(used):
            assert off == at
            at += n
        assert at <= 2048


def test_little_is_left_unused():
    r = random.Random(1)
    hist = Counter(min(2048, int(r.lognormvariate(5, 1.2)) + 1) for _ in range(20_000))
    boxes = {x[2] for x in spread(P.plan_containers(hist))}
    least = -(-sum(n * c for n, c in hist.items()) // 2048)
    assert len(boxes) <= least * 1.01 + 1


def test_plan_size_does_not_follow_the_counts():
    hist = {n: 1 + n % 5 for n in range(1, 2049)}
    small, large = P.plan_containers(hist), P.plan_containers({n: c * 1_000_000 for n, c in hist.items()})
    assert len(large) < 3 * len(small) < 50_000


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_texts(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["sea", "temperature", "fathoms", "ñandú"]) for _ in range(r.choice([1, 20, 300, 1500, 5000])))) for k in range(60)]
    rows += [(100, None), (101, ""), (7, "again"), (7, "again")]
    df = texts(spark, rows).withColumns({"n_tokens": F.lit("x"), "part": F.lit(1), "rank": F.lit(2)})
    out = P.pack_texts(df, group=4).collect()
    enc = encoding(default_path())
    count = Counter()
    for k, t in rows:
        count[k] += len(enc.encode_ordinary(t)) if t else 0
    got = Counter()
    for x in out:
        got[x.doc_id] += x.n_tokens
    assert got == count
    whole = defaultdict(list)
    for x in out:
        if x.container_id is not None:
            whole[x.container_id].append(x)
        else:
            assert (x.n_tokens, x.doc_id) in ((0, 100), (0, 101))
    for xs in whole.values():
        spans = sorted((x.container_offset, x.container_offset + x.n_tokens) for x in xs)
        assert spans[0][0] == 0
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert spans[-1][1] <= 2048
        assert len({(x.step_group, x.tier) for x in xs}) == 1
        assert max(x.n_tokens for x in xs) <= xs[0].tier
    # divided only if longer than a container, into full pieces and a rest
    per_doc = defaultdict(list)
    for x in out:
        per_doc[x.doc_id].append(x)
    for k, xs in per_doc.items():
        if k != 7:
            xs.sort(key=lambda x: x.piece_no)
            assert len(xs) == max(1, -(-count[k] // 2048))
            assert [x.token_start for x in xs] == [2048 * n for n in range(len(xs))]
            assert all(x.n_tokens == 2048 for x in xs[:-1])
    # tiers are shared out evenly
    tiers = defaultdict(Counter)
    for xs in whole.values():
        tiers[xs[0].tier][xs[0].step_group] += 1
    groups = len(whole) // 4
    for c in tiers.values():
        assert max(c.values()) - (min(c.values()) if len(c) == groups else 0) <= 1


def test_empty_and_bad_tiers(spark):
    assert P.pack_texts(texts(spark, [])).count() == 0
    assert P.pack_texts(texts(spark, [(1, None)])).first().container_id is None
    with pytest.raises(ValueError, match="tiers"):
        P.pack_texts(texts(spark, []), capacity=100)


def test_token_bytes():
    path = default_path()
    enc = encoding(path)
    text = "Ost ñ 東京 <|endoftext|>  \n\n"
    assert sum(byte_lengths(path)[t] for t in enc.encode_ordinary(text)) == len(text.encode())
