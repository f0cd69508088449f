"""Best-first discovery of product addresses over many sites at once, in resumable rounds.

Each round every site takes its most promising addresses from its queue, within its
budget, joins them with the documents there are, and queues what they point to. A round
leaves two tables under ``root`` (taken, then queued); the state is all of them
together, so a walk goes on after the last whole round, wherever it was stopped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Depth, requests of a site, points for looking like products, for the market, for a category page, by depth.
MAX_DEPTH, MAX_REQUESTS = 3, 40
PRODUCTISH, LOCALE, CATEGORY, BY_DEPTH = 100, 40, 10, 5
#: What marks an address of products, and of sitemaps.
PRODUCT_WORDS = r"(^|[^a-z])(products?|productos?|artikel|articles?|items?|catalog|pdp)([^a-z]|$)"
SITEMAP_WORDS = r"(?i)sitemaps?|site_?maps?"
SITEMAP_FILE = r"(?i)\.xml(\.gz)?([?#]|$)"
#: Requests that a site makes in a round; 1 is best-first to the letter.
WIDTH = 8

_QUEUE = "site string, url string, depth int, kind string, priority int, round int, place long"
_TAKEN = "site string, url string, depth int, kind string, round int, nth int"


def priority(url: Column, depth: Column, kind: Column, locale_hints: list[str]) -> Column:
    """Points of a queued address; without hints every address is of the right market."""
    productish = F.regexp_like(F.lower(F.regexp_replace(url, SITEMAP_WORDS, "")), F.lit(PRODUCT_WORDS))
    local = reduce(lambda a, b: a | b, [F.contains(F.lower(url), F.lit(h.lower())) for h in locale_hints]) if locale_hints else F.lit(True)
    return (F.when(productish, PRODUCTISH).otherwise(0) + F.when(local, LOCALE).otherwise(0) + F.when(kind == "category", CATEGORY).otherwise(0) + depth * BY_DEPTH).cast("int")


def is_sitemap(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_like(url, F.lit(SITEMAP_FILE)) | F.regexp_like(path, F.lit("(?i)sitemap"))


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(file)


def _all(spark: SparkSession, root: str, name: str, last: int, schema: str) -> DataFrame:
    """The tables of a name up to a round."""
    paths = [f"{root}/{name}-{i}" for i in range(last + 1)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def last_round(spark: SparkSession, root: str) -> int:
    """The last round that is whole; -1 without any."""
    i = -1
    while _exists(spark, f"{root}/queued-{i + 1}"):
        i += 1
    return i


def _queue(found: DataFrame, number: int, locale_hints: list[str]) -> DataFrame:
    """(site, url, depth, kind, place) as rows of the queue: each address once, as it is met first."""
    first = found.groupBy("site", "url").agg(F.min(F.struct("place", "depth", "kind")).alias("f")).select("site", "url", "f.*")
    return first.select("site", "url", F.col("depth").cast("int").alias("depth"), "kind", priority(F.col("url"), F.col("depth"), F.col("kind"), locale_hints).alias("priority"), F.lit(number).alias("round"), F.col("place").cast("long").alias("place"))


def discover(seeds: DataFrame, documents: DataFrame, root: str, locale_hints: list[str] | None = None, width: int = WIDTH, max_depth: int = MAX_DEPTH, max_requests: int = MAX_REQUESTS, rounds: int | None = None) -> bool:
    """Walk on from what is under ``root``; whether the walk is finished.

    ``seeds``: site, url, place (their order). ``documents``: url, links (array<string>,
    in order), one row for each address that can be read. A sitemap's links are queued
    if they are sitemaps too; a category page's second array ``next`` (may be missing)
    goes on to further pages. ``rounds`` stops early, to go on later. A site's queue is
    ordered by priority, then by when and where an address was met; only its best
    ``width`` addresses are ranked, so a site with very many needs no task that sorts
    them all. The number of rounds is at most max_requests / width, rounded up.
    """
    spark, hints = seeds.sparkSession, locale_hints or []
    if not _exists(spark, f"{root}/queued-0"):
        kind = F.when(is_sitemap(F.col("url")), "sitemap").otherwise("category")
        start = seeds.where("site is not null and url is not null").select("site", "url", F.lit(0).alias("depth"), kind.alias("kind"), "place")
        _queue(start, 0, hints).write.mode("overwrite").parquet(f"{root}/queued-0")
    has_next = "next" in documents.columns
    number = last_round(spark, root)
    stop = None if rounds is None else number + rounds
    while stop is None or number < stop:
        queued, taken = _all(spark, root, "queued", number, _QUEUE), _taken(spark, root, number)
        waiting = queued.join(taken.select("site", "url"), ["site", "url"], "left_anti")
        used = taken.groupBy("site").agg(F.count("*").alias("used"))
        order = Window.partitionBy("site").orderBy(F.desc("priority"), "round", "place", "url")
        best = waiting.withColumn("r", F.row_number().over(order)).where(F.col("r") <= width).join(used, "site", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        number += 1
        now = best.where(F.col("used") + F.col("r") <= max_requests).select("site", "url", "depth", "kind", F.lit(number).alias("round"), (F.col("used") + F.col("r")).cast("int").alias("nth"))
        now.write.mode("overwrite").parquet(f"{root}/taken-{number}")
        picked = spark.read.schema(_TAKEN).parquet(f"{root}/taken-{number}")
        finished = picked.isEmpty()
        read = picked.join(documents, "url")
        maps = read.where(F.col("kind") == "sitemap").select("site", "nth", "depth", F.posexplode("links").alias("i", "link")).where(is_sitemap(F.col("link"))).where(F.col("depth") < max_depth).withColumn("kind", F.lit("sitemap"))
        pages = read.where(F.col("kind") == "category").select("site", "nth", "depth", F.posexplode("next").alias("i", "link")).where(F.col("depth") + 1 < max_depth).withColumn("kind", F.lit("category")) if has_next else maps.limit(0)
        met = maps.union(pages).select("site", F.col("link").alias("url"), (F.col("depth") + 1).alias("depth"), "kind", (F.col("nth").cast("long") * 2**32 + F.col("i")).alias("place"))
        fresh = met.where("url is not null").join(queued.select("site", "url"), ["site", "url"], "left_anti")
        _queue(fresh, number, hints).write.mode("overwrite").parquet(f"{root}/queued-{number}")
        if finished:
            return True
    return False


def _taken(spark: SparkSession, root: str, last: int) -> DataFrame:
    paths = [f"{root}/taken-{i}" for i in range(1, last + 1)]
    return spark.read.schema(_TAKEN).parquet(*paths) if paths else spark.createDataFrame([], _TAKEN)


def requests(spark: SparkSession, root: str) -> DataFrame:
    """(site, nth, url, depth, kind): the addresses that were read, in order."""
    return _taken(spark, root, last_round(spark, root)).select("site", "nth", "url", "depth", "kind")


def found_products(spark: SparkSession, root: str, documents: DataFrame, is_product: Column, canonical: Column, limit: int | None = None) -> DataFrame:
    """(site, url, nth): product addresses that the documents read point to, canonical, each with the request that met it first.

    ``is_product`` and ``canonical`` are of the column ``link``. With ``limit``, the first so many of each site.
    """
    links = requests(spark, root).join(documents, "url").select("site", "nth", F.posexplode("links").alias("i", "link")).where(is_product)
    first = links.groupBy("site", canonical.alias("url")).agg(F.min(F.struct("nth", "i")).alias("f")).select("site", "url", "f.nth", "f.i")
    if limit is not None:
        first = first.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy("nth", "i", "url"))).where(F.col("r") <= limit)
    return first.select("site", "url", "nth")
