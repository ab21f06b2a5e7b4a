import random

import duckdb
import pytest

from brinegrid.llm.tokens import byte_lengths, default_path, encode, encoding, long_blanks


@pytest.mark.parametrize("seed", range(40))
def test_cutting_at_blanks_changes_nothing(seed):
    r = random.Random(seed)
    enc = encoding(default_path())
    text = "".join(r.choice([" ", "\n", "\r\n", " ", " ", "\t", "a", "Word", "'s", "12", "!", "é", "　"]) * r.choice([1, 1, 1, 2, 5, 30]) for _ in range(60))
    for least in (1, 2, 3, 10):
        assert encode(enc, text, least, long_blanks(least)) == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000, "a" + " \n" * 500_000 + "b", "\t" * 700_000 + "x" + " " * 700_000])
def test_very_long_blanks(text):
    path = default_path()
    ids = encode(encoding(path), text)
    assert sum(byte_lengths(path)[t] for t in ids) == len(text)
    assert encoding(path).decode(ids) == text


def test_equals_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    enc = encoding(default_path())
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()] + ["<|endoftext|> x", "  a\n\n b"]
    assert [x.ids for x in other.encode_batch(texts, add_special_tokens=False)] == [encode(enc, t) for t in texts]
