"""What the entry point adds when this subpackage is there."""

from ripplework.llm.oracle import SQL
from ripplework.llm.queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
