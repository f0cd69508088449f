"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
SALTS = 64
HOT_FROM = 256
BROADCAST_ROWS = 200_000
#: A saved table of so many keys at most goes to all tasks, and the rows that meet it stay where they are.
BROADCAST_KEYS = 1 << 16


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Keys equal, nulls too; the right side's keys are named ``__k0``, ``__k1``, ..."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__k{i}"]) for i, k in enumerate(keys)])


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in df.columns if c not in keys])


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, spread: str, how: str = "left") -> DataFrame:
    """Join ``rows`` with ``keyed``, which has one row for each key, without a hot task.

    ``weight`` is a column of ``keyed`` that says how many rows of ``rows`` hold the
    key. The ``HOT_KEYS`` heaviest keys (only these are broadcast: keys, no payload,
    so the size is bounded) are dealt over ``SALTS`` tasks by the hash of ``spread``,
    and their rows of ``keyed`` are repeated for each. Any key that is left holds at
    most a ``HOT_KEYS``-th part of the rows. Null keys match null keys. ``keyed`` is
    read twice, so it should be a saved table or cheap to make. A saved table of up to
    ``BROADCAST_KEYS`` keys is broadcast, then no row is shuffled.
    """
    others = [c for c in keyed.columns if c not in keys]
    if hasattr(keyed, "_shared_path") and keyed.count() <= BROADCAST_KEYS:
        right = F.broadcast(_renamed(keyed, keys))
        return rows.join(right, _same(rows, right, keys), how).select(*rows.columns, *others)
    hot = keyed.where(F.col(weight) >= HOT_FROM).orderBy(F.desc(weight), *keys).limit(HOT_KEYS).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(SALTS).alias("__n"))
    drop = [f"__k{i}" for i in range(len(keys))]
    left = rows.join(F.broadcast(hot), _same(rows, hot, keys), "left").drop(*drop).withColumn("__salt", F.when(F.col("__n").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("__n")
    right = keyed.join(F.broadcast(hot), _same(keyed, hot, keys), "left").drop(*drop).withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__n")
    right = _renamed(right, keys)
    return left.join(right, _same(left, right, keys) & (F.col("__salt") == F.col("__s")), how).select(*rows.columns, *others)


def semi_join_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in ``ids`` (a saved table of distinct keys).

    ``ids`` is counted first: up to ``BROADCAST_ROWS`` keys are broadcast, so wide
    rows need not be shuffled; beyond that the rows are shuffled.
    """
    small = ids.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if small else ids, key, "left_semi")
