"""Queries on what models and result sections say, and on the best crop of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.operators import coercion
from vcspark.plans.entities import sql, view
from vcspark.plans.registry import query, table

c = F.col


def _json(**fields: Column) -> Column:
    """A variant of the fields that aren't null."""
    return F.parse_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))


@query(
    sql(
        """SELECT query_id, pos, title, CASE WHEN pos = 6 THEN NULL ELSE link END AS link, coalesce(store, regexp_replace(regexp_extract(link, '^[a-z]+://([^/]+)', 1), '^www\\.', '')) AS store, image_url,
  CASE pos % 3 WHEN 2 THEN price ELSE floor(price) END AS price, CASE pos % 3 WHEN 1 THEN CASE WHEN price IS NOT NULL THEN 'EUR' END WHEN 2 THEN CASE WHEN price IS NOT NULL THEN 'GBP' END END AS currency, exact FROM candidates WHERE pos <> 6""",
        "candidates",
    )
)
def section_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of result sections under several names for each field; those without link are discarded."""
    whole = F.floor("price").cast("long")
    at = lambda n, x: F.when(c("pos") % 3 == n, x)
    doc = F.when(
        c("pos") % 3 == 2,
        _json(name=c("title"), product_link=c("link"), seller=c("store"), image=F.struct(c("image_url").alias("url")), price=F.when(c("price").isNotNull(), F.struct(c("price").alias("value"), F.lit("GBP").alias("currency")))),
    ).otherwise(_json(title=c("title"), link=F.when(c("pos") != 6, c("link")), source=c("store"), thumbnail=c("image_url"), price=F.coalesce(at(1, F.concat(F.lit("desde "), whole, F.lit(" €"))), at(0, whole.cast("string")))))
    docs = coercion.held(view(spark, d, "candidates"), doc=doc)
    rows = coercion.held(docs.select("query_id", "pos", "exact", "doc"), f=F.struct(*coercion.columns(coercion.section_fields(c("doc")))))
    return rows.where("f.title is not null and f.link is not null").select("query_id", "pos", *coercion.columns(coercion.section_row(c("f"), c("exact"))))


@query(
    sql(
        """+ r AS (SELECT query_id, pos, product_id, title, brand, CASE WHEN price > 0 AND pos % 2 = 0 THEN round(price, 2) END AS price, CASE WHEN pos % 3 = 0 THEN 0.7 WHEN pos % 3 = 1 THEN least(1, (product_id % 100 + 2) / 100) ELSE product_id % 10 / 10 END::DOUBLE AS similarity FROM candidates)
SELECT query_id, pos, product_id, title, brand, price, similarity FROM r""",
        "candidates",
    )
)
def recommendation_rows(spark: SparkSession, d: str) -> DataFrame:
    """A model's recommendations with their price and scale put right."""
    k = c("product_id")
    similarity = F.when(c("pos") % 3 == 1, (k % 100 + 2).cast("double")).when(c("pos") % 3 == 2, k % 10 / 10)
    doc = _json(title=F.concat(F.lit("  "), c("title")), brand=c("brand"), approx_price_eur=F.when(c("pos") % 2 == 0, c("price")).otherwise(F.lit(-1.0)), similarity=similarity)
    return coercion.held(view(spark, d, "candidates"), doc=doc).select("query_id", "pos", "product_id", *coercion.columns(coercion.recommendation_row(c("doc"))))


@query(
    sql(
        """SELECT query_id, pos, product_id, CASE pos % 4 WHEN 0 THEN 'product' WHEN 1 THEN 'listing' ELSE 'unknown' END AS kind, CASE WHEN pos % 4 <> 1 THEN title END AS title, CASE WHEN pos % 4 <> 1 THEN brand END AS brand,
  CASE WHEN pos % 4 NOT IN (1, 3) THEN product_id + 1000.5 END::DOUBLE AS price, CASE pos % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence FROM candidates""",
        "candidates",
    )
)
def extraction_rows(spark: SparkSession, d: str) -> DataFrame:
    """A model's extractions coerced: placeholders, prices, confidence, and listings that say nothing of a product."""
    p = c("pos") % 4
    price = F.when(p == 3, F.lit("-5,00")).otherwise(F.regexp_replace(F.format_number(c("product_id") + 1000.5, 2), ",", ""))
    doc = _json(
        productType=F.get(F.array(F.lit("product"), F.lit("listing"), F.lit("other")), p.cast("int")), title=F.concat(c("title"), F.lit(" ")), brand=F.coalesce("brand", F.lit("N/A")), price=price,
        confidence=F.get(F.array(F.lit("7"), F.lit("0.25"), F.lit("high")), p.cast("int")),
    )
    docs = coercion.held(view(spark, d, "candidates"), doc=doc)
    rows = coercion.held(docs, f=F.struct(*coercion.columns(coercion.extraction_fields(c("doc")))))
    return rows.select("query_id", "pos", "product_id", *coercion.columns(coercion.extraction_row(c("f"))))


@query(
    """WITH f AS (SELECT user_id, event_type, list({'quality': value, 'has_box': event_id % 9 > 0, 'id': event_id} ORDER BY ts, event_id) AS e FROM events GROUP BY ALL)
SELECT user_id, event_type, b.id AS event_id, b.quality AS quality FROM (SELECT user_id, event_type, list_reduce(e, lambda h, n: CASE WHEN n.quality > h.quality * 1.15::DOUBLE OR NOT h.has_box THEN n ELSE h END) AS b FROM f)"""
)
def best_crop_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """The crop that each track holds at the end, if a new one must be better by 15 % to replace it."""
    entry = F.struct("ts", c("event_id").alias("id"), c("value").alias("quality"), (c("event_id") % 9 > 0).alias("has_box"))
    tracks = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    best = tracks.select("user_id", "event_type", coercion.best_by_hysteresis(c("e")).alias("b"))
    return best.select("user_id", "event_type", c("b.id").alias("event_id"), c("b.quality").alias("quality"))


@query(
    sql(
        """SELECT query_id, pos, product_id, price, CASE WHEN score * 500 > price THEN score * 500 END AS original_price, upper(coalesce(currency, 'eur')) AS currency,
  len(list_distinct(list_filter([store, brand, store], lambda x: x IS NOT NULL)))::INTEGER AS sizes FROM candidates""",
        "candidates",
    )
)
def extraction_projection(spark: SparkSession, d: str) -> DataFrame:
    """A product's row from an extraction: a former price only if it is a discount, sizes trimmed and distinct."""
    sizes = F.array_distinct(F.filter(F.transform(F.array("store", "brand", "store"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return view(spark, d, "candidates").select(
        "query_id", "pos", "product_id", "price", F.when(c("score") * 500 > c("price"), c("score") * 500).alias("original_price"), F.upper(F.coalesce("currency", F.lit("eur"))).alias("currency"),
        F.size(sizes).alias("sizes"),
    )


@query(
    sql(
        """SELECT job_id, item_no, trim(name) AS name, coalesce(nullif(lower(trim(category)), ''), 'general') AS category, least(1, greatest(0, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) AS confidence,
  (floor(item_no * 2.6::DOUBLE / 5) * 5)::BIGINT AS bucket, array_to_string(list_filter([name, pattern, visible_brand], lambda x: x IS NOT NULL), ' ') AS query FROM items""",
        "items",
    )
)
def item_projection(spark: SparkSession, d: str) -> DataFrame:
    """A detected item's row from a model's output: trimmed, within its scale, with its time bucket and query."""
    from vcspark.functions.links import unit_scale
    from vcspark.functions.text import time_bucket

    category = F.coalesce(F.nullif(F.lower(F.trim("category")), F.lit("")), F.lit("general"))
    return view(spark, d, "items").select("job_id", "item_no", F.trim("name").alias("name"), category.alias("category"), unit_scale(c("confidence")).alias("confidence"), time_bucket(c("item_no") * 2.6).alias("bucket"), F.concat_ws(" ", "name", "pattern", "visible_brand").alias("query"))


@query(
    """WITH b AS (SELECT event_id, event_id % 11 / 10.0::DOUBLE AS x, value / 200 AS w, CASE WHEN event_id % 2 = 0 THEN least(640 / 1280.0::DOUBLE, 480 / 720.0::DOUBLE) ELSE greatest(640 / 1280.0::DOUBLE, 480 / 720.0::DOUBLE) END AS s FROM events)
SELECT event_id, round((640 - 1280 * s) / 2 + x * 1280 * s, 4) AS left_px, round(w * 1280 * s, 4) AS width_px FROM b"""
)
def fitted_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a frame as pixels of an element of another shape: contained in it (bars) or covering it (cut)."""
    from vcspark.functions import geometry

    k = c("event_id")
    b = geometry.box(k % 11 / 10.0, F.lit(0.0), c("value") / 200, F.lit(1.0))
    shown = geometry.fitted(b, 1280, 720, 640, 480, k % 2 == 1)
    return table(spark, d, "events").select("event_id", F.round(shown["x"], 4).alias("left_px"), F.round(shown["width"], 4).alias("width_px"))


@query(
    """WITH f AS (SELECT user_id, event_id, ts, CASE WHEN p IS NULL OR abs(value - p) / 1000 >= 0.08::DOUBLE THEN 1 ELSE 0 END AS changed FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)),
g AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
SELECT event_id, changed = 1 OR (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) % 4 = 0 AS sent FROM g"""
)
def frame_skip(spark: SparkSession, d: str) -> DataFrame:
    """Frames that a client sends: those that differ by 0.08 or more from the one before, and every fourth of a run that doesn't."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("value").over(order)
    frames = table(spark, d, "events").withColumn("changed", (before.isNull() | (F.abs(c("value") - before) / 1000 >= 0.08)).cast("int")).withColumn("run", F.sum("changed").over(order))
    place = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id")) - 1
    return frames.select("event_id", ((c("changed") == 1) | (place % 4 == 0)).alias("sent"))
