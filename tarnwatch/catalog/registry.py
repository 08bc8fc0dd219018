"""Registered queries: a Spark callable, and the SQL that must give the same rows where SQL can say it."""

from functools import wraps

from tarnwatch.shipping import ensure_on_workers

from .oracle import oracle

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: `fn(spark, sf_dir) -> DataFrame`; `sql` may mention any named CTE."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark, sf_dir):
            ensure_on_workers(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return fn

    return add
