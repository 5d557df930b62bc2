"""Operators of a training-data pipeline (extraction, classifiers, dedup, tokens, search, scoring).

Nothing else in the library imports this package.  ``queries`` holds one query per operator and
the pipeline; ``oracle_sql`` the SQL of those that SQL can express.
"""

from __future__ import annotations


def queries() -> dict:
    """Name to ``(spark, sf_dir) -> DataFrame``."""
    from kestrel.llm.registry import QUERIES
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from kestrel.llm.registry import ORACLE_SQL
    return dict(ORACLE_SQL)
