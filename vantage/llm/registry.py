"""Registry of this subpackage's queries and oracle SQL."""

from __future__ import annotations

from functools import wraps

from vantage.session import share_code

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def with_code(fn):
    """``fn`` after Python workers were told where this package is."""

    @wraps(fn)
    def run(spark, *args, **kwargs):
        share_code(spark)
        return fn(spark, *args, **kwargs)

    return run


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = with_code(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
