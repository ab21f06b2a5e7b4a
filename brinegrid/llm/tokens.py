"""A public byte-level BPE tokenizer, loaded once per Python worker."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer whose ranks are at path; special tokens' strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fixed value: the characters a tokenizer's pattern counts as white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def long_blanks(least: int) -> re.Pattern:
    return re.compile(f"[{_WHITE}]{{{least},}}")


_LONG, _BLANKS = 10_000, long_blanks(10_000)


def encode(enc, text: str, least: int = _LONG, blanks: re.Pattern = _BLANKS) -> list[int]:
    """Token ids of a text of any length.

    The tokenizer's pattern overflows its stack on very long runs of blanks. Such a run, all but its last character (which
    may belong to the word after it), is one piece of that pattern: it is encoded as such, and the text around it as usual.
    """
    if len(text) < least or not (runs := list(blanks.finditer(text))):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in runs:
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        if stop > m.start():
            out += enc._encode_single_piece(text[m.start() : stop])
        at = stop
    return out + enc.encode_ordinary(text[at:])


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each token, by id."""
    enc = encoding(path)
    out = np.zeros(enc.n_vocab, dtype=np.int64)
    for t in enc.token_byte_values():
        out[enc.encode_single_token(t)] = len(t)
    return out
