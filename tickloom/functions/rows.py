"""Small relational idioms used across operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Conjunction of equalities on same-named columns."""
    condition = F.lit(True)
    for name in keys:
        condition = condition & (left[name] == right[name])
    return condition


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] | None = None
) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    ``max_by`` aggregates map-side, so a key with very many copies shrinks to one candidate per
    input partition before the shuffle. ``order`` must be total for a deterministic pick.
    """
    columns = [c for c in (keep or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in columns]), F.struct(*order)).alias("_row")
    )
    return picked.select(*[F.col(k) for k in keys], *[F.col("_row")[c].alias(c) for c in columns])


def replace_by_key(current: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Next state of a keyed table: rows of ``delta`` displace rows of ``current``."""
    kept = current.join(delta.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(delta.select(*current.columns))


def at_least_one(count: int) -> int:
    """A row count asked for, as it is; below one it is an error."""
    if int(count) < 1:
        raise ValueError(f"at least one row must be asked for, not {count}")
    return int(count)


def count_where(condition: Column) -> Column:
    """Rows satisfying a condition, as bigint."""
    return F.count(F.when(condition, F.lit(1)))
