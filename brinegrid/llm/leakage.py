"""Finding passages of held-out test items in a corpus, also partial and slightly altered ones.

Pigeonhole edit matching: what is looked for is a stretch of at least `least` words of an item, in one part or two, with
up to one edit in ten words. Cut into as many pieces as there can be edits and parts, plus one, one piece must occur
unaltered. So every run of that many words of every item is a piece; documents are searched for exact hits of pieces.
Where one is hit, all agreements of item and document are taken: each is widened over edits as far as it goes for every
number of edits, the results are combined, and the distance is verified with Myers' bit-parallel algorithm.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import columns as C

LEAST, RATE = 25, 10
#: Items of so many words together are sent to every task (about 16 bytes a word); more are joined by their pieces.
MOST_WORDS = 2_000_000

_TAG = re.compile(r"</?(?P<name>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
# Tags that stand inside words and sentences.
_INLINE = {"a", "abbr", "b", "code", "em", "font", "i", "mark", "s", "small", "span", "strong", "sub", "sup", "u", "wbr"}
_UNICODE = re.compile(r"\\u\{?([0-9a-fA-F]{4})\}?")
_HEX = re.compile(r"\\x([0-9a-fA-F]{2})")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_QUOTE_MARKS = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\u0300-\u036f]")
_JOINED = re.compile(r"(?<=\w)(?:['’‘ʼ`´]|[-‐‑]\s*)(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def plain_words(text: str) -> list[str]:
    """The words of a text, without what doesn't count as a difference: case, punctuation, accents, spacing, line breaks,
    quote marks at line starts, markup, escapes, invisible characters. Words joined by hyphens or apostrophes are one."""
    if "\\" in text:
        text = _UNICODE.sub(lambda m: chr(int(m[1], 16)), text)
        text = _HEX.sub(lambda m: chr(int(m[1], 16)), text)
        text = text.replace("\\n", " ").replace("\\r", " ").replace("\\t", " ").replace("\\", "")
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "%" in text and _PERCENT.search(text):
        text = unquote(text, errors="ignore")
    if "<" in text:
        text = _TAG.sub(lambda m: "" if (m["name"] or "").lower() in _INLINE else " ", text)
    if ">" in text or "|" in text:
        text = _QUOTE_MARKS.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).replace("œ", "oe").replace("æ", "ae").replace("Œ", "OE").replace("Æ", "AE")
        text = text.casefold()
    else:
        text = text.lower()
    return _WORD.findall(_JOINED.sub("", text))


def myers(pattern: Sequence[int], text: Sequence[int]) -> int:
    """Edit distance of two sequences, bit-parallel over the pattern."""
    m = len(pattern)
    if not m:
        return len(text)
    peq: dict[int, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        peq[c] |= 1 << k
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        if mh & high:
            score -= 1
        ph = (ph << 1) | 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return score


def _threes(seq: np.ndarray) -> np.ndarray:
    """Codes of all runs of three words; word numbers are below 2^21, so codes are exact. Words numbered 0 agree with nothing."""
    s = seq.astype(np.int64)
    return (s[:-2] << 42) | (s[1:-1] << 21) | s[2:] if len(s) > 2 else np.zeros(0, np.int64)


class _Item:
    """An item's words, and its runs of one and of three words in order, to look up."""

    def __init__(self, seq: list[int]):
        self.seq = seq
        self.tables = []
        for codes in (np.array(seq, np.int64), _threes(np.array(seq, np.int64))):
            order = np.argsort(codes, kind="stable")
            self.tables.append((codes[order], order))

    def agreements(self, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document positions, item positions) of all runs of size words that agree."""
        have, at = self.tables[size // 3]
        lo, hi = np.searchsorted(have, codes, "left"), np.searchsorted(have, codes, "right")
        n = hi - lo
        k = np.repeat(np.arange(len(codes)), n)
        return k, at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(k))]


def _runs(k: np.ndarray, j: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Agreements on one diagonal, joined to longest runs (document, item, length)."""
    order = np.lexsort((k, k - j))
    k, j = k[order], j[order]
    d = k - j
    new = np.ones(len(k), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1] + 1)
    first = np.nonzero(new)[0]
    return list(zip(k[first].tolist(), j[first].tolist(), (np.diff(np.append(first, len(k))) + size - 1).tolist()))


def _reach(doc: Sequence[int], item: Sequence[int], k: int, j: int, way: int, most: int) -> list[tuple[int, int, int]]:
    """(edits, document words, item words) that can be walked from the gap before (k, j) in direction way, with ever more edits
    and ever more item words, to where words agree. The furthest point of every diagonal is kept for each number of edits."""
    nd, ni = (len(doc) - k, len(item) - j) if way > 0 else (k + 1, j + 1)
    out, best = [(0, 0, 0)], 0
    front = {0: 0}  # diagonal (document words - item words) -> item words walked
    for e in range(1, most + 1):
        nxt: dict[int, int] = {}
        for d in range(-e, e + 1):
            y = max(front.get(d, -2) + 1, front.get(d + 1, -2) + 1, front.get(d - 1, -1))
            if y < 0 or y > ni or y + d < 0 or y + d > nd:
                continue
            z = y
            while z < ni and z + d < nd and doc[k + way * (z + d)] == item[j + way * z]:
                z += 1
            nxt[d] = z
            if z > y and z > best:
                best, at = z, (e, z + d, z)
        front = nxt
        if best > out[-1][2]:
            out.append(at)
    return out


def _parts(doc: Sequence[int], item: Sequence[int], run: tuple[int, int, int], most: int) -> set[tuple[int, int, int, int, int]]:
    """A run widened both ways: (document from, to, item from, to, edits), for all numbers of edits up to most."""
    k, j, n = run
    on = _reach(doc, item, k + n, j + n, 1, most)
    back = _reach(doc, item, k - 1, j - 1, -1, most)
    return {(k - b[1], k + n + a[1], j - b[2], j + n + a[2], a[0] + b[0]) for a in on for b in back if a[0] + b[0] <= most}


def _longer(p: tuple[int, int, int, int, int], least: int) -> bool:
    """Whether a part can be the longer one of two: it is half of the whole at least, and the whole is within the rate."""
    return 2 * (p[3] - p[2]) >= max(least, RATE * p[4])


def _two(doc: Sequence[int], item: Sequence[int], parts: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(words, edits, 2) of two parts in the order of both document and item, together long enough and within the rate.

    Parts that run into each other give up what they share. The longer part is at least half of the whole, so few parts
    are tried as the longer one, each against all others at once.
    """
    k0, k1, j0, j1, e = parts.T
    n = j1 - j0
    for x in np.nonzero((2 * n >= least) & (2 * n >= RATE * e))[0][np.argsort(-n[(2 * n >= least) & (2 * n >= RATE * e)], kind="stable")].tolist():
        later = (k0 > k0[x]) & (k1 > k1[x]) & (j0 > j0[x]) & (j1 > j1[x])
        sooner = (k0 < k0[x]) & (k1 < k1[x]) & (j0 < j0[x]) & (j1 < j1[x])
        shared = np.maximum(0, np.where(later, np.maximum(j1[x] - j0, k1[x] - k0), np.maximum(j1 - j0[x], k1 - k0[x])))
        whole = n[x] + n - shared
        ok = (later | sooner) & (shared < n) & (shared < n[x]) & (whole >= least) & (RATE * (e[x] + e) <= whole)
        for y in np.nonzero(ok)[0][np.argsort(-whole[ok], kind="stable")].tolist():
            p, q = (parts[x].tolist(), parts[y].tolist()) if later[y] else (parts[y].tolist(), parts[x].tolist())
            o = int(shared[y])
            for a, b in ((o, 0), (0, o)) if o else ((0, 0),):
                made = myers(item[p[2] : p[3] - a], doc[p[0] : p[1] - a]) + myers(item[q[2] + b : q[3]], doc[q[0] + b : q[1]])
                if made * RATE <= whole[y]:
                    return int(whole[y]), made, 2
    return None


def leaked(doc: Sequence[int], item: _Item, singles: np.ndarray, threes: np.ndarray, least: int = LEAST) -> tuple[int, int, int] | None:
    """(words, edits, parts) of a passage of item in doc, or None. singles and threes: codes of the document's runs.

    A passage of at least three times `least` words holds a shorter one within the rate, so no more edits than that has
    are walked over. A part begins and ends with agreeing words.
    """
    most = (3 * least - 1) // RATE
    k, j = item.agreements(threes, 3)
    if not len(k):
        return None
    # n words with e edits in two parts keep n - 3e - 4 runs of three, half of them near one diagonal
    d = np.sort(k - j)
    near = np.searchsorted(d, d + most, "right") - np.arange(len(d))
    half = -(-min(n - 3 * (n // RATE) - 4 for n in range(least, 3 * least)) // 2)
    dense = near >= half
    if not dense.any():
        return None
    seq = item.seq
    parts: set[tuple] = set()
    begins = np.unique(d[dense])
    runs = np.array(_runs(k, j, 3))
    diagonal = runs[:, 0] - runs[:, 1]
    before = np.searchsorted(begins, diagonal, "right") - 1
    likely = (before >= 0) & (diagonal <= begins[before] + most)
    for some in (likely, ~likely):  # those near a dense diagonal first: one of the parts is there, and keeps that many runs of three
        for run in sorted(map(tuple, runs[some].tolist()), key=lambda r: -r[2]):
            new = _parts(doc, seq, run, most) - parts
            for p in new:
                n = p[3] - p[2]
                if n >= least and p[4] * RATE <= n:
                    edits = myers(seq[p[2] : p[3]], doc[p[0] : p[1]])
                    if edits * RATE <= n:
                        return n, edits, 1
            parts |= new
        if not any(p[3] - p[2] >= half + 2 * (p[4] + 1) for p in parts):
            return None
    got = _two(doc, seq, np.array(sorted(parts)), least)
    if got:
        return got
    # the shorter part may have no run of three: then it has at most 2 + 3e words
    if any(_longer(p, least) and (n := p[3] - p[2]) + 2 + 3 * max(0, (n + 2 + 3 * most) // RATE - p[4]) >= least for p in parts):
        for run in _runs(*item.agreements(singles, 1), 1):
            parts |= _parts(doc, seq, run, most)
        return _two(doc, seq, np.array(sorted(parts)), least)
    return None


def piece_size(least: int) -> int:
    """One piece more than edits and the parting: of that many pieces of `least` words one is unaltered."""
    return least // (least // RATE + 2)


def _hashes(seq: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size numbers."""
    n = len(seq) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h + seq[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class ItemIndex:
    """The pieces of items: hashes of all their runs of `size` words."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.size = piece_size(least)
        self.least = least
        self.words: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            seq = [self.words.setdefault(w, len(self.words) + 1) for w in plain_words(text)]
            if len(seq) >= least:
                self.ids.append(item_id)
                self.items.append(_Item(seq))
        rows = [_hashes(np.array(x.seq, dtype=np.uint64), self.size) for x in self.items]
        hashes = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(h) for h in rows])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, words, edits, parts) of every item of which text holds a passage."""
        get = self.words.get
        doc = [get(w, 0) for w in plain_words(text)]
        singles = np.array(doc, dtype=np.int64)
        h = _hashes(singles.astype(np.uint64), self.size)
        if not len(h) or not len(self.hashes):
            return []
        lo, hi = np.searchsorted(self.hashes, h, side="left"), np.searchsorted(self.hashes, h, side="right")
        hit = [self.owner[a:z] for a, z in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist())]
        if not hit:
            return []
        threes = _threes(singles)
        out = []
        for n in np.unique(np.concatenate(hit)).tolist():
            got = leaked(doc, self.items[n], singles, threes, self.least)
            if got:
                out.append((self.ids[n], *got))
        return out


def _piece_rows(least: int):
    """For mapInArrow over (key, text): (key, piece), the hashes of all pieces of a text, each once. Words are numbered by their hash."""
    size = piece_size(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):
                seq = np.array([xxhash.xxh64_intdigest(w) for w in plain_words(text)], dtype=np.uint64)
                h = np.unique(_hashes(seq, size)).view(np.int64)
                if len(seq) >= least and len(h):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1).take(pa.array(np.zeros(len(h), np.int64))), pa.array(h)], names=["key", "piece"])

    return run


def _verified(least: int):
    """For mapInArrow over (key, item key, text, item text): the pairs that hold a passage, with its words, edits and parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, rows = [], []
            for k, (text, item) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                got = ItemIndex([(0, item)], least).search(text)
                if got:
                    idx.append(k)
                    rows.append(got[0][1:])
            if rows:
                at = pa.array(idx)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(x, pa.int32()) for x in zip(*rows)]], names=["key", "item_key", "n_words", "n_edits", "n_parts"])

    return run


def _by_pieces(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """(d, i, n_words, n_edits, n_parts) for docs (d, text) and items (i, text) of any number: pieces meet by a join on their hash.

    Equal texts are searched for and through once, under a key made of two hashes. A piece that many texts share is a hot
    key of the join, which AQE splits; pairs are made distinct before any text travels.
    """
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    docs, items = docs.withColumn("key", key), items.withColumn("item_key", key)
    texts = docs.dropDuplicates(["key"]).select("key", "text")
    asked = items.dropDuplicates(["item_key"]).select("item_key", F.col("text").alias("item_text"))
    kind = "key struct<a:bigint,b:bigint>, piece bigint"
    have = texts.mapInArrow(_piece_rows(least), kind)
    want = asked.mapInArrow(_piece_rows(least), kind).withColumnRenamed("key", "item_key")
    pairs = have.join(want, "piece").select("key", "item_key").distinct()
    full = pairs.join(asked, "item_key").join(texts, "key").select("key", "item_key", "text", "item_text")
    found = full.mapInArrow(_verified(least), "key struct<a:bigint,b:bigint>, item_key struct<a:bigint,b:bigint>, n_words int, n_edits int, n_parts int")
    return found.join(items.select("item_key", "i"), "item_key").join(docs.select("key", "d"), "key").select("d", "i", "n_words", "n_edits", "n_parts")


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits, n_parts): the documents that hold passages of items.

    A passage is least or more words of the item in their order, in one part or in two with foreign text between, each
    beginning and ending with a word that agrees, with at most one word in ten altered, left out or added; words are those
    of plain_words. The parts may be of any length. n_words, n_edits and n_parts tell of one such passage. An item of fewer
    words, null and empty texts yield nothing. Repeated documents count each for itself; an item that occurs twice is two
    items. Empty tables give an empty result; extra columns are ignored, and the two tables may use the same names.

    Documents are read once, whatever the number of items. Items whose texts hold no more than most_words words (their
    characters are counted first, two to a word at least) are sent to every task, and documents are neither shuffled nor cut;
    larger sets of items meet the documents by a join on the hash of their pieces.
    """
    schema = T.StructType(
        [
            T.StructField(doc_id, docs.schema[doc_id].dataType),
            T.StructField(C.free_name([doc_id], item_id), items.schema[item_id].dataType),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("n_edits", T.IntegerType()),
            T.StructField("n_parts", T.IntegerType()),
        ]
    )
    spark = docs.sparkSession
    narrow = docs.select(C.quoted(doc_id).alias("d"), C.quoted(doc_text).alias("text")).where(F.length("text") >= least)
    asked = items.select(C.quoted(item_id).alias("i"), C.quoted(item_text).alias("text")).where(F.length("text") >= least)
    chars = asked.agg(F.sum(F.length("text").cast("bigint"))).first()[0]
    if chars is None:
        return spark.createDataFrame([], schema)
    if chars > 2 * most_words:
        return _by_pieces(narrow, asked, least).toDF(*schema.names)
    index = spark.sparkContext.broadcast(ItemIndex([(r["i"], r["text"]) for r in asked.collect()], least))
    item_type = to_arrow_type(schema[1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for row in index.value.search(text):
                    idx.append(k)
                    rows.append(row)
            if rows:
                item, n, e, p = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(idx)), pa.array(item, item_type), *[pa.array(x, pa.int32()) for x in (n, e, p)]], names=schema.names)

    return narrow.mapInArrow(run, schema)
