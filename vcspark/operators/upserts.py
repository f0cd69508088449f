"""Merges of a base table with new rows, as grouped aggregations: no row-level table format is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(base: DataFrame, delta: DataFrame, keys: list[str], recency: str, tie: str) -> DataFrame:
    """The newest row of each key; ties go to the larger ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(recency), F.desc_nulls_last(tie))
    return base.unionByName(delta).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def insert_or_ignore(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and those rows of ``delta`` whose key isn't in it (one each)."""
    return base.unionByName(delta.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def additive_upsert(base: DataFrame, delta: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters added up by key; null keys are equal to each other."""
    return base.select(*keys, *counters).unionByName(delta.select(*keys, *counters)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def greatest_upsert(base: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    return base.select(*keys, value).unionByName(delta.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


def fingerprint_upsert(base: DataFrame, delta: DataFrame, key: str = "fingerprint", seq: str = "seq", most: str = "confidence", latest: tuple[str, ...] = (), lists: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Merge by fingerprint: the largest ``most``, the newest stated value of ``latest``, the newest list of ``lists`` that isn't empty, the oldest ``keep``; seen_count adds up, created tells new keys."""
    rows = base.withColumn("__base", F.lit(1)).unionByName(delta.withColumn("__base", F.lit(0)))
    aggregates = [F.max(most).alias(most), F.sum("seen_count").alias("seen_count"), (F.max("__base") == 0).alias("created")]
    aggregates += [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in latest]
    aggregates += [F.max_by(c, F.when(F.size(c) > 0, F.col(seq))).alias(c) for c in lists]
    aggregates += [F.min_by(c, seq).alias(c) for c in keep]
    return rows.groupBy(key).agg(*aggregates)


def coalesce_upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join by key in which stated new values win over old ones."""
    others = [c for c in base.columns if c not in keys]
    b = base.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in others])
    return b.join(delta, keys, "full").select(*keys, *[F.coalesce(F.col(c), F.col(f"__b_{c}")).alias(c) for c in others])
