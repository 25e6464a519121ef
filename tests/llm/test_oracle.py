"""Every query of the subpackage with SQL against DuckDB; the others run."""

import pytest

from ripplework.llm import registry
from tests.conftest import SMALL, same_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(spark, duck, name):
    same_rows(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_core_does_not_need_the_subpackage():
    import pathlib

    import ripplework

    root = pathlib.Path(ripplework.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "ripplework.llm" not in f.read_text(), f
