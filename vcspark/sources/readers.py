"""Readers for datasets, sitemaps and robots files, and a versioned writer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dataset_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header and doubled quotes; blank and NA (any case) are null, rows without id are dropped."""
    rows = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    cleaned = [F.when(~F.lower(F.trim(c)).isin("", "na"), F.trim(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    return rows.select(*cleaned).where("id is not null")


def sitemap_locations(xml: Column | str) -> Column:
    """The addresses in a sitemap, CDATA and entities resolved."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    amp = lambda u: F.replace(F.replace(F.replace(u, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(found, amp), lambda u: u != "")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, allow, prefix) of the rules for all agents, from (host, text)."""
    lines = robots.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    parts = lines.select("host", "n", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]*:\s*([^#]*)", 1)).alias("value"))
    from pyspark.sql import Window

    order = Window.partitionBy("host").orderBy("n")
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(order)
    return parts.withColumn("agent", agent).where("agent = '*' and key in ('allow', 'disallow') and value <> ''").select("host", (F.col("key") == "allow").alias("allow"), F.col("value").alias("prefix"))


def allowed_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, allowed): the longest matching prefix decides, allow before disallow; no rule: allowed."""
    escaped = F.regexp_replace(F.regexp_replace("prefix", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    met = paths.join(rules, "host", "left").withColumn("fits", F.regexp_like("path", F.concat(F.lit("^"), escaped)))
    best = met.groupBy("host", "path").agg(F.max(F.when(F.col("fits"), F.struct(F.length("prefix"), "allow"))).alias("b"))
    return best.select("host", "path", F.coalesce(F.col("b.allow"), F.lit(True)).alias("allowed"))


def write_version(df: DataFrame, root: str) -> str:
    """Write a table to a new version folder under ``root`` and return it; readers switch when the caller stores the name."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions of ``key`` that ``df`` has, so a repeated run leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)

