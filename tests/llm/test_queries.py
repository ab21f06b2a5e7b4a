import re

import pytest

from brinegrid.llm import queries as Q
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, tiny, name):
    df = Q.QUERIES[name](spark, tiny)
    if name in Q.SQL:
        assert_same(df, connect(tiny), Q.SQL[name])
    else:
        assert df.count() > 0


def test_the_rest_does_not_import_this_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "brinegrid"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
