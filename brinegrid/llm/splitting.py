"""Cutting texts over a token limit into pieces with overlap, by agglomerative merging at natural boundaries.

A text starts as atomic segments. Adjacent segments are held in a heap and merged, weakest boundary first, as long as
the merged size plus the overlap fits; what boundaries remain are the strongest that the limit allows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import columns as C
from .tokens import byte_lengths, default_path, encode, encoding

LIMIT, OVERLAP = 1024, 64
#: Strength of a boundary: inside a character (never cut), inside a word, between words, clauses, sentences, lines, paragraphs.
INSIDE, ANY, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(-1, 6)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# The last bytes of full-width stops and commas, after their common lead.
_WIDE_STOPS = ("。", "！", "？", "．")
_WIDE_COMMAS = ("、", "，", "；", "：")


def boundary_strengths(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The strength of a cut before each byte position in at (0 < at < len(data))."""
    prev, nxt = data[at - 1], data[at]
    out = np.where((nxt & 0xC0) == 0x80, INSIDE, ANY)
    space = _SPACE[nxt] | _SPACE[prev]
    out[space & (out >= 0)] = WORD
    # what ends before the cut, past any blanks: the last byte that is no space
    is_space = _SPACE[data]
    idx = np.where(is_space, 0, np.arange(len(data)))
    last = np.maximum.accumulate(idx)[at - 1]
    end = data[last]
    out[space & np.isin(end, list(b",;:")) & (out >= 0)] = CLAUSE
    out[space & np.isin(end, list(b".!?")) & (out >= 0)] = SENTENCE
    long = at >= 3
    tri = np.zeros(len(at), dtype=np.int64)
    a = at[long]
    tri[long] = (data[a - 3].astype(np.int64) << 16) | (data[a - 2].astype(np.int64) << 8) | data[a - 1]
    code = lambda s: [int.from_bytes(c.encode(), "big") for c in s]
    out[np.isin(tri, code(_WIDE_COMMAS)) & (out >= 0)] = CLAUSE
    out[np.isin(tri, code(_WIDE_STOPS)) & (out >= 0)] = SENTENCE
    newline = data == 10
    seen = np.concatenate([[0], np.cumsum(newline)])
    # newlines between the last word before the cut and the next word after it
    rev = np.where(is_space, len(data), np.arange(len(data)))
    first = np.minimum.accumulate(rev[::-1])[::-1][at]
    breaks = seen[first] - seen[last]
    out[(breaks >= 1) & (out >= 0)] = LINE
    out[(breaks >= 2) & (out >= 0)] = PARAGRAPH
    return out


def _atoms(strength: np.ndarray, n: int, most: int) -> list[int]:
    """Token positions where atomic segments begin, 0 first. strength[i]: of the cut before token i + 1."""
    cuts = [0]
    for level in (SENTENCE, CLAUSE, WORD, ANY):
        new = []
        for a, z in zip(cuts, [*cuts[1:], n]):
            new.append(a)
            if z - a > most:
                inner = np.nonzero(strength[a : z - 1] >= level)[0] + a + 1
                if level == ANY:  # nothing natural is left: even steps
                    step, last = max(1, most // 4), a
                    kept = []
                    for c in inner:
                        if c - last >= step:
                            kept.append(int(c))
                            last = c
                    inner = kept
                new.extend(int(c) for c in inner)
        cuts = new
        if all(z - a <= most for a, z in zip(cuts, [*cuts[1:], n])):
            break
    return cuts


def merge_atoms(cuts: list[int], n: int, strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Where the pieces begin. Equal strengths: the smaller merged size first, then the earlier one."""
    k = len(cuts)
    begin, end = list(cuts), [*cuts[1:], n]
    right, left, alive = [*range(1, k), -1], [-1, *range(k - 1)], [True] * k
    room = lambda a: limit if a == 0 else limit - overlap
    # a first piece shorter than the overlap couldn't share that much with the second
    while k > 1 and right[0] >= 0 and end[0] < overlap and end[right[0]] <= limit:
        j = right[0]
        end[0], right[0], alive[j] = end[j], right[j], False
        if right[j] >= 0:
            left[right[j]] = 0
    heap: list[tuple] = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and end[j] - begin[i] <= room(begin[i]):
            heapq.heappush(heap, (int(strength[begin[j] - 1]), end[j] - begin[i], begin[i], i, j))

    for i in range(k):
        if alive[i]:
            offer(i)
    while heap:
        _, size, _, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or end[j] - begin[i] != size:
            continue
        end[i], right[i], alive[j] = end[j], right[j], False
        if right[j] >= 0:
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [begin[i] for i in range(k) if alive[i]]


def split_tokens(text: str, path: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int, int]] | None:
    """(piece, first own token, first token, end token) of a text over the limit, else None."""
    data_b = text.encode("utf-8", "surrogatepass")
    if len(data_b) <= limit:  # a token is at least one byte
        return None
    enc = encoding(path)
    ids = encode(enc, text)
    n = len(ids)
    if n <= limit:
        return None
    ends = np.cumsum(byte_lengths(path)[np.array(ids)])
    data = np.frombuffer(data_b, dtype=np.uint8)
    strength = boundary_strengths(data, ends[:-1])
    starts = np.concatenate([[0], ends])
    tight = limit
    while True:
        most = tight - overlap - 3
        cuts = merge_atoms(_atoms(strength, n, most), n, strength, tight, overlap + 3)
        out, over = [], 0
        for a, z in zip(cuts, [*cuts[1:], n]):
            f = max(0, a - overlap) if a else 0
            while f > 0 and strength[f - 1] == INSIDE:  # a shared stretch begins with a whole character
                f -= 1
            piece = data_b[starts[f] : starts[z]].decode("utf-8", "surrogatepass")
            if z - f > limit - 16:  # cut out of its context a piece may take more tokens than in it
                over = max(over, len(encode(enc, piece)) - limit, z - f - limit)
            out.append((piece, a, f, z))
        if over <= 0:
            return out
        tight -= over


def split_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None) -> DataFrame:
    """(id_col, piece_no, n_pieces, token_own, token_from, token_to, piece): the pieces of every text of more than limit tokens.

    piece is the text of tokens [token_from, token_to) of the whole; [token_own, token_to) of all pieces are the whole
    text, once. Neighbours share the overlap: exactly `overlap` tokens, or up to three more where those would begin inside
    a character. No piece takes more than limit tokens, also when tokenized anew. Cuts lie at the strongest boundaries
    that the limit allows (paragraph, line, sentence, clause, word), inside a word only where a word alone is too long,
    never inside a character. Texts of up to limit tokens, null and empty texts have no pieces. Repeated rows are cut
    each for itself. An empty table gives an empty result. No shuffle. limit must be at least four overlaps.
    """
    if limit < 4 * overlap or limit < 32:
        raise ValueError("limit must be at least 32 and four times the overlap")
    path = vocabulary or default_path()
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("n_pieces", T.IntegerType()),
            T.StructField("token_own", T.LongType()),
            T.StructField("token_from", T.LongType()),
            T.StructField("token_to", T.LongType()),
            T.StructField("piece", T.StringType()),
        ]
    )
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                pieces = split_tokens(text, path, limit, overlap) if text else None
                for no, (piece, a, f, z) in enumerate(pieces or ()):
                    idx.append(k)
                    rows.append((no, len(pieces), a, f, z, piece))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(idx)), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=schema.names)

    # texts that can't be over the limit never reach Python: a token is at least one byte
    long = df.where(F.octet_length(C.quoted(text_col)) > limit)
    return long.select(C.quoted(id_col), C.quoted(text_col)).mapInArrow(run, schema)
