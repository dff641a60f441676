"""Fail-loud checks and joins that keep their promise about cardinality."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """An input breaks a documented requirement."""


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{what}: missing columns {missing}")
    return df


def assert_no_nulls(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    """One aggregation over all columns; NaN counts as null in doubles."""
    kinds = dict(df.dtypes)
    bad = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    row = df.agg(*[F.count_if(bad(c)).alias(c) for c in columns]).first()
    found = {c: row[c] for c in columns if row[c]}
    if found:
        raise ContractError(f"{what}: nulls in {found}")
    return df


def assert_domain(df: DataFrame, column: str, allowed: Sequence[str], what: str) -> DataFrame:
    extra = [r[0] for r in df.where(~F.col(column).isin(*allowed)).select(column).distinct().limit(5).collect()]
    if extra:
        raise ContractError(f"{what}: {column} outside {list(allowed)}: {extra}")
    return df


def assert_weights(df: DataFrame, column: str, what: str) -> DataFrame:
    """Weights are present and not negative."""
    if df.where(F.col(column).isNull() | (F.col(column) < 0)).limit(1).count():
        raise ContractError(f"{what}: {column} has null or negative weights")
    return df


def assert_unique(df: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    twice = df.groupBy(*key).count().where("count > 1").limit(3).collect()
    if twice:
        raise ContractError(f"{what}: key {list(key)} repeats, e.g. {[tuple(r) for r in twice]}")
    return df


def merge_checked(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "left", validate: str = "m:1", unmatched: str = "keep") -> DataFrame:
    """Equi-join whose "1" sides are checked first; ``unmatched`` = keep, drop or raise governs left rows without partner."""
    if validate.endswith(":1"):
        assert_unique(right, key, "right side of the merge")
    if validate.startswith("1:"):
        assert_unique(left, key, "left side of the merge")
    if unmatched == "raise":
        lost = left.join(right.select(*key), list(key), "left_anti").limit(1).count()
        if lost:
            raise ContractError(f"rows without a partner on {list(key)}")
    return left.join(right, list(key), "inner" if unmatched == "drop" else how)


def dedupe_apply(df: DataFrame, key: Sequence[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``fn`` on the distinct keys only and join its columns back: expensive work once per distinct value, null keys too."""
    made = fn(df.select(*key).distinct())
    made = made.select(*[F.col(k).alias(f"_key_{k}") for k in key], *[c for c in made.columns if c not in key])
    same = F.lit(True)
    for k in key:
        same = same & df[k].eqNullSafe(made[f"_key_{k}"])
    return df.join(made, same, "left").drop(*[f"_key_{k}" for k in key])


def drop_nulls_counted(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, int]:
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    return df.where(~any_null), df.where(any_null).count()
