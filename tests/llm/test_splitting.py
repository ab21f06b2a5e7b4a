import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinegrid.llm import splitting as S
from brinegrid.llm.tokens import byte_lengths, default_path, encoding

PATH = default_path()


def random_text(seed, n):
    r = random.Random(seed)
    words = ["sea", "temperature", "fathoms", "ñandú", "lantern", "gyre", "東京湾の水温。", "7.25", "extraordinarily"]
    out = []
    for _ in range(n):
        out.append(r.choice(words) + r.choice([" ", " ", " ", ", ", ". ", ".\n", "\n\n", "; "]))
    return "".join(out)


CASES = {
    "prose": random_text(1, 4000),
    "lines": "\n".join(random_text(k, 12).replace("\n", " ") for k in range(200)),
    "no spaces": "".join(random.Random(3).choice("0123456789abcdef") for _ in range(9000)),
    "japanese": "海面水温は平年より高い" * 600,
    "blanks": "a" + " " * 20_000 + "b",
    "rule": "=" * 200_000,
    "just over": " sea" * 1025,
    "emoji": "🐟🛥️" * 1500,
    "breaks": "\n" * 5000 + "x" + "\r\n" * 3000,
    "one long paragraph first": random_text(5, 1200).replace("\n", " ") + "\n\n" + "end. " * 400,
}


@pytest.mark.parametrize("name", CASES)
def test_pieces(name):
    text = CASES[name]
    enc = encoding(PATH)
    ids = enc.encode_ordinary(text)
    pieces = S.split_tokens(text, PATH)
    assert pieces
    starts = np.concatenate([[0], np.cumsum(byte_lengths(PATH)[np.array(ids)])])
    data = text.encode()
    at = 0
    for k, (piece, own, f, z) in enumerate(pieces):
        assert own == at  # own parts are the whole, once
        at = z
        assert piece.encode() == data[starts[f] : starts[z]]
        assert z - f <= 1024
        assert len(enc.encode_ordinary(piece)) <= 1024
        if k:
            assert 64 <= own - f <= 67
            assert f >= pieces[k - 1][2]
        else:
            assert f == 0
    assert at == len(ids)
    assert len(pieces) <= 3 * len(ids) / 960 + 2


def test_cuts_are_natural():
    text = "\n\n".join(random_text(k, 60).replace("\n", " ") for k in range(120))
    cuts = [own for _, own, _, _ in S.split_tokens(text, PATH)][1:]
    enc = encoding(PATH)
    ids = enc.encode_ordinary(text)
    ends = np.cumsum(byte_lengths(PATH)[np.array(ids)])
    strength = S.boundary_strengths(np.frombuffer(text.encode(), np.uint8), ends[:-1])
    assert all(strength[c - 1] == S.PARAGRAPH for c in cuts)


def test_strengths():
    s = "One two, three. Four\nfive\n\nsix 東。京"
    data = np.frombuffer(s.encode(), np.uint8)
    at = {w: s.encode().index(w.encode()) for w in (" two", " three", " Four", "five", "six", "ne ", "京")}
    got = dict(zip(at, S.boundary_strengths(data, np.array(list(at.values())))))
    assert got == {" two": S.WORD, " three": S.CLAUSE, " Four": S.SENTENCE, "five": S.LINE, "six": S.PARAGRAPH, "ne ": S.ANY, "京": S.SENTENCE}
    assert S.boundary_strengths(data, np.array([len(data) - 1]))[0] == S.INSIDE


def brute_merge(cuts, n, strength, limit, overlap):
    """The same rule without a heap."""
    parts = [list(x) for x in zip(cuts, [*cuts[1:], n])]
    while len(parts) > 1 and parts[0][1] < overlap and parts[1][1] <= limit:
        parts[0:2] = [[0, parts[1][1]]]
    while True:
        can = [(int(strength[b[0] - 1]), b[1] - a[0], a[0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if b[1] - a[0] <= (limit if a[0] == 0 else limit - overlap)]
        if not can:
            return [p[0] for p in parts]
        k = min(can)[3]
        parts[k : k + 2] = [[parts[k][0], parts[k + 1][1]]]


@pytest.mark.parametrize("seed", range(20))
def test_heap_equals_brute_force(seed):
    r = random.Random(seed)
    n = r.randrange(50, 400)
    strength = np.array([r.randrange(0, 6) for _ in range(n - 1)])
    cuts = sorted({0, *(r.randrange(1, n) for _ in range(r.randrange(1, 60)))})
    limit, overlap = r.choice([(64, 8), (100, 20), (200, 1)])
    assert S.merge_atoms(cuts, n, strength, limit, overlap) == brute_merge(cuts, n, strength, limit, overlap)


def test_table(spark):
    rows = [(1, CASES["prose"]), (1, CASES["prose"]), (2, None), (3, ""), (4, "short"), (5, " sea" * 1024), (6, CASES["just over"]), (None, CASES["rule"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit(1), "piece_no": F.lit("x")})
    out = S.split_texts(df).collect()
    assert {x.doc_id for x in out} == {1, 6, None}
    ones = sorted(x.piece_no for x in out if x.doc_id == 1)
    assert ones == sorted(2 * list(range(len(ones) // 2)))
    assert S.split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        S.split_texts(df, limit=100, overlap=64)
