"""Exact dedup against immutable snapshots.

A snapshot is a table of the distinct texts of all batches so far: for each SHA-256
digest the row that stays and the number of copies. Digests fall into buckets, and
each bucket of a snapshot has a static binary-fuse filter. Of a new batch, duplicates
among themselves are grouped first; the distinct digests are screened by the filters;
only the positives are joined with the snapshot's exact buckets, where the texts'
bytes are compared.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vcspark.llm import fuse_filter
from vcspark.operators.skew import salted_join, semi_join_ids
from vcspark.sources.shared import save_shared

DIGESTS_PER_BUCKET = 100_000
LEAST_BUCKETS = 1024


def normalised(text: Column | str) -> Column:
    """Each run of space and U+0009..U+000D as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _key(column: str) -> Column:
    """The first eight bytes of a digest as a long."""
    return F.conv(F.substring(F.hex(column), 1, 15), 16, 10).cast("long")


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("key", _key("sha")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) of an immutable snapshot's digests (sha)."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": group.bucket.iloc[:1], "filter": [fuse_filter.build(group.key.to_numpy())]})

    return _bucketed(snapshot, buckets).select("bucket", "key").groupBy("bucket").applyInPandas(one, "bucket int, filter binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests (sha) of ``groups`` that a snapshot's filters let pass: all that it holds, and few others."""

    def one(group: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(filters):
            return group[["sha"]].iloc[:0]
        return group[["sha"]][fuse_filter.contains(filters["filter"].iloc[0], group.key.to_numpy())]

    return _bucketed(groups, buckets).select("bucket", "key", "sha").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(one, "sha binary")


def add_batch(snapshot: DataFrame | None, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """The next snapshot (sha, keep_id, size, met): ``snapshot`` with a batch's ``groups`` (sha, keep_id, size).

    ``texts`` (doc_id, text) has the texts of both, for the byte check of digests that
    occur in both; two texts that share a digest but differ stop the run, as no
    SHA-256 collision is known.
    """
    if snapshot is None:
        return groups
    digests = max(snapshot.count(), groups.count())
    buckets = max(LEAST_BUCKETS, -(-digests // DIGESTS_PER_BUCKET))
    passed = screen(groups, build_filters(snapshot, buckets), buckets)
    old = snapshot.select("sha", F.col("keep_id").alias("old_id"), F.col("size").alias("old_size"))
    new = groups.select("sha", F.col("keep_id").alias("new_id"), F.col("size").alias("new_size"))
    both = save_shared(passed.join(old, "sha").join(new, "sha"), "dedup-positives")
    ids = save_shared(both.select(F.explode(F.array("old_id", "new_id")).alias("doc_id")).where("doc_id is not null").distinct(), "dedup-ids")
    wanted = semi_join_ids(texts, ids, "doc_id").select("doc_id", normalised("text").alias("text"), F.unhex(F.sha2(normalised("text"), 256)).alias("sha"))
    wanted = save_shared(wanted.groupBy("doc_id", "sha").agg(F.min("text").alias("text")), "dedup-texts")
    side = lambda c: wanted.select("sha", F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"))
    checked = both.join(side("old_id"), ["sha", "old_id"], "left").join(side("new_id"), ["sha", "new_id"], "left")
    equal = F.col("old_id_text").eqNullSafe(F.col("new_id_text")) | F.col("old_id").isNull() | F.col("new_id").isNull()
    same = checked.select("sha", "old_id", "old_size", "new_id", "new_size", F.when(equal, True).otherwise(F.raise_error(F.lit("texts differ that share a SHA-256 digest"))).alias("same"))
    merged = save_shared(same.where("same").select("sha", F.least("old_id", "new_id").alias("keep_id"), (F.col("old_size") + F.col("new_size")).alias("size")), "dedup-merged")
    apart = snapshot.unionByName(groups).join(merged, "sha", "left_anti")
    return save_shared(apart.unionByName(merged), "dedup-snapshot")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Texts are equal if they are after each run of space and U+0009..U+000D became one
    space; null counts as empty, and the row with the smallest id stays. Rows go into
    ``batches`` by quantiles of the id, each batch against the snapshot of those before
    it; the result is the same for any number. A null id is larger than any other; if
    all ids of a group are null, keep_id is null and all its rows are kept. Rows that
    share both id and text are one document: all carry the same decision. Columns of
    the input other than the two are not read, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = save_shared(source.select("doc_id", F.unhex(F.sha2(normalised("text"), 256)).alias("sha")), "dedup-digests")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first().c if batches > 1 else []
    number = reduce(lambda n, cut: n + F.coalesce((F.col("doc_id") > cut).cast("int"), F.lit(1)), cuts or [], F.lit(0))
    groups = save_shared(rows.groupBy(number.alias("batch"), "sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size")), "dedup-groups")
    snapshot = None
    for i in range(batches):
        snapshot = add_batch(snapshot, groups.where(F.col("batch") == i).drop("batch"), source)
    out = salted_join(rows, snapshot, ["sha"], "size", "doc_id")
    return out.select("doc_id", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
