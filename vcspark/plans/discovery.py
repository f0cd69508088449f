"""A walk over sites whose sitemaps list the pages: an index by site, a sitemap by language and hundred, category pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.operators import frontier
from vcspark.plans.registry import query, table
from vcspark.sources.shared import new_shared_path

HINTS = ["/en/"]


def sites(spark: SparkSession, d: str) -> DataFrame:
    """(site, lang, part, link): every page under its site (the address's last two names), language and hundred."""
    parts = table(spark, d, "pages").select(F.regexp_extract("url", r"://([^/?#]*)/([a-z]+)/([0-9]+)", 1).alias("host"), F.regexp_extract("url", r"://([^/?#]*)/([a-z]+)/([0-9]+)", 2).alias("lang"), F.regexp_extract("url", r"://([^/?#]*)/([a-z]+)/([0-9]+)", 3).alias("n"), F.col("url").alias("link"))
    named = parts.where("n <> ''").withColumn("site", F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)).withColumn("site", F.when(F.col("site") == "", F.col("host")).otherwise(F.col("site")))
    return named.select("site", "lang", F.floor(F.col("n").cast("long") / 100).alias("part"), "link")


def documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The seeds, and what can be read: (url, links, next)."""
    rows = sites(spark, d)
    index = F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap.xml"))
    by_lang = F.concat(F.lit("https://"), F.col("site"), F.lit("/"), F.col("lang"), F.lit("/sitemap.xml"))
    by_part = F.concat(F.lit("https://"), F.col("site"), F.lit("/"), F.col("lang"), F.when(F.col("part") % 2 == 0, "/products-").otherwise("/news-"), F.col("part"), F.lit(".xml"))
    category = F.concat(F.lit("https://"), F.col("site"), F.lit("/"), F.col("lang"), F.lit("/all/"))
    level = lambda url, link: rows.select(url.alias("url"), link.alias("link")).distinct().groupBy("url").agg(F.sort_array(F.collect_list("link")).alias("links"))
    none = F.array().cast("array<string>")
    maps = level(index, by_lang).union(level(by_lang, by_part)).union(level(by_part, F.col("link"))).select("url", "links", none.alias("next"))
    pages = rows.select(F.concat(category, F.col("part")).alias("url"), "link", F.concat(category, F.col("part") + 1).alias("further")).groupBy("url").agg(F.sort_array(F.collect_set("link")).alias("links"), F.array(F.min("further")).alias("next"))
    seeds = rows.select("site", index.alias("url"), F.lit(0).alias("place")).union(rows.select("site", F.concat(category, F.lit(0)), F.lit(1))).distinct()
    return seeds, maps.union(pages)


@query()
def discovered_products(spark: SparkSession, d: str) -> DataFrame:
    """Pages that each site's walk finds within its budget, with the request that met them first."""
    from vcspark.sources.shared import save_shared

    seeds, read = documents(spark, d)
    read = save_shared(read, "discovery-documents")
    root = new_shared_path(spark, "discovery")
    frontier.discover(seeds, read, root, HINTS)
    product = F.regexp_like("link", F.lit(r"/[0-9]+([/?#]|$)"))
    return frontier.found_products(spark, root, read, product, F.regexp_replace("link", r"[?#].*$|/$", ""))
