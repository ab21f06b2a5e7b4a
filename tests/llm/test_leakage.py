import random

import pytest
from pyspark.sql import functions as F

from brinegrid.llm import leakage as K

R = random.Random(0)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randrange(2, 9))) for _ in range(400)]


FOREIGN = ["f" + w for w in VOCABULARY]  # words no item has: others agree with an item's here and there


def words(r, n):
    return [r.choice(VOCABULARY) for _ in range(n)]


def dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_myers_equals_dynamic_programming(seed):
    r = random.Random(seed)
    a = [r.randrange(4) for _ in range(r.randrange(0, 90))]
    b = [r.randrange(4) for _ in range(r.randrange(0, 90))]
    assert K.myers(a, b) == dp(a, b)


SENTENCE = "L'aube, près de Zürich: rope-makers counted 12 cœurs."


@pytest.mark.parametrize(
    "form",
    [
        "L’AUBE PRÈS DE ZÜRICH ROPE-MAKERS COUNTED 12 CŒURS",
        "laube pres de zurich ropemakers counted 12 coeurs",
        "> L'aube, près\n> de Zürich: rope-\n> makers counted 12 cœurs.",
        "<p>L'aube, <b>près</b> de&nbsp;Z&uuml;rich: rope-makers<br/>counted 12 c&oelig;urs.</p>",
        "L\\u0027aube, pr\\u00e8s de Z\\u00fcrich: rope-makers\\ncounted 12 c\\u0153urs.",
        "L'au­be, pr​ès de Zürich: rope-makers counted 12  cœurs.",
        "L%27aube%2C pr%C3%A8s de Z%C3%BCrich: rope-makers counted 12 c%C5%93urs",
        "_L'aube_, **près** de `Zürich`: rope‑makers counted 12 cœurs",
    ],
)
def test_forms_that_are_no_difference(form):
    assert K.plain_words(form) == K.plain_words(SENTENCE)


def altered(r, seq, edits):
    out = list(seq)
    for _ in range(edits):
        k = r.randrange(len(out))
        what = r.randrange(3)
        if what == 0:
            out[k] = "zz" + out[k]
        elif what == 1:
            out.insert(k, "zzz")
        else:
            del out[k]
    return out


def search(item, doc):
    return K.ItemIndex([(1, " ".join(item))]).search(" ".join(doc))


@pytest.mark.parametrize("seed", range(60))
def test_planted_passages_are_found(seed):
    r = random.Random(seed)
    item = words(r, r.randrange(40, 150))
    n = r.randrange(27, 40)
    at = r.randrange(len(item) - n + 1)
    part = altered(r, item[at : at + n], r.randrange(0, n // 13 + 1))
    assert search(item, words(r, 80) + part + words(r, 80))
    # in two parts with foreign text between
    cut = len(part) // 2
    assert search(item, words(r, 30) + part[:cut] + words(r, 25) + part[cut:] + words(r, 30))


@pytest.mark.parametrize("seed", range(60))
def test_what_is_no_case(seed):
    r = random.Random(seed)
    item = words(r, 120)
    at = r.randrange(90)
    assert not search(item, r.choices(FOREIGN, k=50) + item[at : at + 22] + r.choices(FOREIGN, k=50))
    # two parts in the wrong order, three parts, and too many edits
    a, b = item[10:26], item[60:76]
    assert not search(item, b + r.choices(FOREIGN, k=20) + a)
    assert not search(item, item[5:14] + r.choices(FOREIGN, k=9) + item[30:39] + r.choices(FOREIGN, k=9) + item[60:69])
    worn = [w if k % 4 else "q" + w for k, w in enumerate(item[:60])]
    assert not search(item, worn)


def test_exactly_least():
    r = random.Random(1)
    item = words(r, 60)
    assert search(item, item[20:45])[0] == (1, 25, 0, 1)
    assert not search(item, ["x"] + item[20:44] + ["y"])
    assert search(item, item[3:16] + ["x"] * 5 + item[40:52])[0][3] == 2


@pytest.mark.parametrize("first", range(1, 25))
def test_parts_of_any_length(first):
    """25 words in two parts, cut anywhere, are found; 24 are not."""
    r = random.Random(first)
    item = words(r, 60)
    foreign = lambda n: r.choices(FOREIGN, k=n)
    for n, want in ((25, True), (24, False)):
        a, b = item[20 : 20 + first], item[20 + first : 20 + n]
        assert bool(search(item, foreign(30) + a + foreign(9) + b + foreign(30))) == want


def inner(r, seq, edits):
    """Edits at single words that are neither the first nor the last of seq."""
    out = list(seq)
    for k in sorted(r.sample(range(1, len(out) - 1), edits), reverse=True):
        what = r.randrange(3)
        out[k : k + 1] = [["zz" + out[k]], ["zzz", out[k]], []][what]
    return out


def test_recall_of_least_passages_in_two_parts():
    """The smallest passages, with as many edits as may be, cut anywhere."""
    found = tried = 0
    for seed in range(800):
        r = random.Random(seed)
        item = words(r, r.randrange(40, 140))
        n = r.randrange(25, 40)
        at = r.randrange(len(item) - n + 1)
        cut, edits = r.randrange(1, n), r.randrange(n // 10 + 1)
        a, b = item[at : at + cut], item[at + cut : at + n]
        left = min(edits, max(0, cut - 2), r.randrange(n // 10 + 1))
        right = min(edits - left, max(0, len(b) - 2))
        tried += 1
        found += bool(search(item, r.choices(FOREIGN, k=40) + inner(r, a, left) + r.choices(FOREIGN, k=9) + inner(r, b, right) + r.choices(FOREIGN, k=40)))
    assert found >= 0.99 * tried, (found, tried)


def test_adjacent_edits_and_edits_near_the_end():
    r = random.Random(9)
    item = words(r, 40)
    foreign = lambda n: r.choices(FOREIGN, k=n)
    for k in range(1, 23):  # two altered words, one good word between them
        part = item[5:30]
        part[k] = "zz"
        part[min(23, k + 2)] = "zzz"
        assert search(item, foreign(30) + part + foreign(30)), k
    part = item[5:30]
    part[23] = "zz"  # the second-to-last
    assert search(item, foreign(3) + part + foreign(3))


def test_many_items_are_joined_by_their_pieces(spark):
    r = random.Random(6)
    texts = [words(r, 60) for _ in range(40)]
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(99, " ".join(texts[0])), (100, None)], "item_id long, text string")
    rows = []
    for k in range(120):
        t = r.choice(texts)
        at, cut = r.randrange(20), r.randrange(5, 25)
        rows.append((k % 100, " ".join(words(r, 20) + t[at : at + cut] + r.choices(FOREIGN, k=5) + t[at + cut : at + r.choice([12, 30])])))
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (7, None), (8, "")], "doc_id long, text string")
    key = lambda df: sorted(((x.doc_id, x.item_id) for x in df.collect()), key=str)
    sent = key(K.find_leaks(docs, items))
    assert sent and sent == key(K.find_leaks(docs, items, most_words=10))
    assert K.find_leaks(docs.limit(0), items, most_words=10).count() == 0


def test_table(spark):
    r = random.Random(4)
    item = words(r, 50)
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, ""), (5, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    long = " ".join(words(r, 30_000) + item + words(r, 10))
    docs = spark.createDataFrame([(10, long), (10, long), (11, None), (12, ""), (13, "x" * 100_000), (14, " ".join(words(r, 500))), (None, " ".join(item))], "doc_id long, text string").withColumns({"item_id": F.lit("z"), "n_words": F.lit(1)})
    got = sorted(((x.doc_id, x.item_id) for x in K.find_leaks(docs, items).collect()), key=str)
    assert got == sorted([(10, 1), (10, 2)] * 2 + [(None, 1), (None, 2)], key=str)
    blocks = sorted(((x.doc_id, x.item_id) for x in K.find_leaks(docs, items, most_words=1).collect()), key=str)
    assert blocks == got
    assert K.find_leaks(docs.limit(0), items).count() == 0
    assert K.find_leaks(docs, items.limit(0)).count() == 0
