"""Queries that take line items as listings, in order, into a catalogue of half the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.operators.ingest import import_counters, ingest, ingested_catalogue
from vcspark.plans.registry import query, table

_BATCH = [
    "l_orderkey * 8 + l_linenumber AS seq", "'s' || (l_suppkey % 3) AS source", "cast(l_partkey AS string) AS source_product_id", "CASE WHEN l_linenumber = 1 THEN 'https://shop.example.org/p/' || (l_partkey + l_suppkey % 2) END AS canonical_url",
    "CASE WHEN l_tax > 0.07 THEN md5(concat(l_partkey, '/', l_shipmode)) END AS image_sha256", "CASE WHEN l_discount > 0.09 THEN 'k' || (l_partkey + l_suppkey) ELSE '' END AS sku", "CASE WHEN l_quantity > 48 THEN 'g' || l_partkey END AS gtin",
    "md5(concat(l_partkey, '|', l_quantity % 3)) AS content_hash", "l_partkey + l_quantity % 3 AS price", "l_shipdate AS seen",
]
_CATALOGUE = [
    "p_partkey AS id", "'s' || (p_size % 3) AS source", "cast(p_partkey AS string) AS source_product_id", "CASE WHEN p_size > 25 THEN 'https://shop.example.org/p/' || p_partkey END AS canonical_url", "cast(NULL AS string) AS image_sha256",
    "'k' || p_partkey AS sku", "CASE WHEN p_size > 40 THEN 'g' || p_partkey END AS gtin", "md5(concat(p_partkey, '|', 1)) AS content_hash", "p_partkey + 1.0D AS price", "'dataset_demo' AS origin",
    "timestamp'1990-01-01' AS first_seen", "timestamp'1990-01-01' AS last_seen", "array(named_struct('seen', timestamp'1990-01-01', 'price', p_partkey + 1.0D)) AS history",
]


def listings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("l_shipmode", F.col("l_returnflag")).dropDuplicates(["l_orderkey", "l_linenumber"])
    return rows.selectExpr(*_BATCH)


def products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_partkey % 2 = 0").selectExpr(*_CATALOGUE)


@query()
def ingest_batch(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each listing: new, changed, unchanged or a duplicate, and of which product."""
    return ingest(listings(spark, d), products(spark, d))


@query()
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """The batch's counters."""
    return import_counters(ingest(listings(spark, d), products(spark, d)))


@query()
def ingest_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after the batch; histories as numbers of points."""
    from vcspark.sources.shared import save_shared

    batch, catalogue = listings(spark, d), products(spark, d)
    done = ingested_catalogue(catalogue, batch, save_shared(ingest(batch, catalogue), "ingest-outcomes"))
    return done.withColumn("points", F.size("history")).drop("history")
