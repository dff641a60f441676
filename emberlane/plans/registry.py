"""Registered queries: each applies operators to the fixture views, with the same result in DuckDB SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles at so many digits, so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, *tables: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> Callable:
    """Register a function of the named views; ``doubles`` are the double columns of its SQL."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(*[view(spark, sf_dir, t) for t in tables]), digits)
        if sql:
            body = with_views(sql)
            cols = ", ".join(f"round({c}, {digits}) AS {c}" for c in doubles.split())
            ORACLE[name] = f"SELECT * REPLACE ({cols}) FROM ({body}) AS q" if cols else body
        return fn

    return register


def load() -> None:
    from emberlane.plans import modelling, panels, relational, storage, texts  # noqa: F401, I001
    from emberlane.plans import composed  # noqa: F401  (after those whose SQL it compares with)


