"""Queries on texts, boxes, histories and site files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.functions import geometry, links, taxonomy
from vcspark.functions import text as texts
from vcspark.operators import dedup, extraction, timeline, upserts
from vcspark.plans.entities import sql, view
from vcspark.plans.registry import query, table
from vcspark.sources import readers

c = F.col


@query("SELECT doc_id, contains(' ' || regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', ' ', 'g') || ' ', ' the ') AS held FROM documents")
def word_containment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", texts.contains_word("text", F.lit("The")).alias("held"))


@query(
    """WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Shirts' WHEN 1 THEN 'ring' WHEN 2 THEN 'sneakers' WHEN 3 THEN 'all' END AS a, CASE p_partkey % 3 WHEN 0 THEN 'shirt' WHEN 1 THEN 'sneaker' ELSE 'footwear' END AS b FROM part)
SELECT p_partkey, CASE WHEN a IS NULL OR a = 'all' THEN true WHEN a = 'Shirts' THEN b = 'shirt' WHEN a = 'sneakers' THEN b = 'footwear' ELSE false END AS compatible FROM p"""
)
def category_compatible(spark: SparkSession, d: str) -> DataFrame:
    """Equal once canonical, or one is the other's family, or nothing stated."""
    a = F.get(F.array(F.lit("Shirts"), F.lit("ring"), F.lit("sneakers"), F.lit("all"), F.lit(None)), (c("p_size") % 5).cast("int"))
    b = F.get(F.array(F.lit("shirt"), F.lit("sneaker"), F.lit("footwear")), (c("p_partkey") % 3).cast("int"))
    return table(spark, d, "part").select("p_partkey", taxonomy.categories_match(a, b).alias("compatible"))


_BOXES = "b AS (SELECT event_id, event_id % 11 / 10.0::DOUBLE AS x, event_id % 7 / 10.0::DOUBLE AS y, value / 200 AS w, event_id % 5 / 5.0::DOUBLE AS h FROM events)"


@query(
    f"""WITH {_BOXES} SELECT event_id, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 1.001 AND y + h <= 1.001 AS valid, w * h > 0.85 AS oversized, w * h >= 0.7 AS covers,
  x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 1.001 AND y + h <= 1.001 AND least(w, h) >= 0.1 AND w * h >= 0.02 AS searchable,
  round(least(1, greatest(0, x)) , 6) AS left_edge, round(greatest(0, least(1, x + w)) - least(1, greatest(0, x)), 6) AS cut_width FROM b"""
)
def box_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Valid, oversized, searchable boxes, those that cover most of the frame, and their part inside it."""
    k = c("event_id")
    b = geometry.box(k % 11 / 10.0, k % 7 / 10.0, c("value") / 200, k % 5 / 5.0)
    inside = geometry.clamped(b)
    return table(spark, d, "events").select(
        "event_id", geometry.valid_box(b).alias("valid"), geometry.oversized(b).alias("oversized"), geometry.covers_frame(b).alias("covers"), geometry.searchable(b, 0.1, 0.02).alias("searchable"),
        F.round(inside["x"], 6).alias("left_edge"), F.round(inside["width"], 6).alias("cut_width"),
    )


@query("SELECT p_partkey, sha256('{\"f0\":\"' || p_name || '\",\"f1\":\"' || p_brand || '\",\"f2\":' || p_size || ',\"f3\":' || CASE WHEN p_type = 'PROMO' THEN '\"PROMO\"' ELSE 'null' END || '}') AS hash FROM part")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """What changes if a product's content does; null differs from empty."""
    promo = F.when(c("p_type") == "PROMO", c("p_type"))
    return table(spark, d, "part").select("p_partkey", dedup.content_hash(c("p_name"), c("p_brand"), c("p_size"), promo).alias("hash"))


@query(sql("SELECT relationship, job_id, item_no FROM items QUALIFY row_number() OVER (PARTITION BY relationship ORDER BY seen_at DESC, job_id DESC, item_no DESC) <= 200", "items"))
def capped_histories(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 entries of each history: a retention rule."""
    rows = view(spark, d, "items").withColumn("tie", F.struct("job_id", "item_no"))
    return timeline.capped_history(rows, ["relationship"], "seen_at", "tie").select("relationship", "job_id", "item_no")


@query("WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_filter(roles, lambda x, i: list_position(roles, x) = i)[1:2], '/') AS first_roles FROM t")
def first_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first two different roles of a conversation, in order, case aside."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"])
    shout = lambda r: F.transform(r, lambda x, i: F.when(i % 2 == 1, F.upper(x)).otherwise(x))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(roles.alias("roles"))
    return rows.select("conv_id", F.lower(F.array_join(texts.ordered_distinct(shout(c("roles")), 2), "/")).alias("first_roles"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*/([^/?#]+/)*[a-z]{2}([/?#]|$)') THEN true ELSE false END AS localised FROM pages")
def localised_pages(spark: SparkSession, d: str) -> DataFrame:
    """Whether an address has a locale among its parts."""
    return table(spark, d, "pages").select("page_id", texts.url_locale("url").isNotNull().alias("localised"))


@query("SELECT unnest([page_id, page_id]) AS page_id, unnest(['https://x.org/p?a=1&b=' || page_id, url]) AS location FROM pages")
def sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    """The addresses of sitemaps, entities and CDATA resolved."""
    plain = F.concat(F.lit("<url><loc> https://x.org/p?a=1&amp;b="), c("page_id"), F.lit("</loc></url>"))
    quoted = F.concat(F.lit("<url><LOC><![CDATA["), c("url"), F.lit("]]></LOC></url>"))
    xml = F.concat(F.lit("<urlset>"), plain, quoted, F.lit("<url><loc></loc></url></urlset>"))
    return table(spark, d, "pages").select("page_id", F.explode(readers.sitemap_locations(xml)).alias("location"))


@query(
    """WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT host, path, NOT (starts_with(path, '/e') AND NOT starts_with(path, '/en') OR regexp_matches(path, '^/.*/1')) OR starts_with(path, '/en/12') AS allowed FROM p"""
)
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Whether the longest rule that fits a path allows it."""
    found = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path")).distinct()
    file = "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /e\nAllow: /en\nDisallow: /*/1\nAllow: /en/12 # comment\nDisallow:"
    rules = readers.robots_rules(found.select("host").distinct().withColumn("text", F.lit(file)))
    return readers.allowed_paths(found, rules)


@query(
    """SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'footwear' WHEN p_size % 6 = 1 THEN 'accessory' WHEN p_size % 6 = 2 THEN 'electronics' WHEN p_size % 6 = 3 THEN 'home' WHEN p_size % 6 = 4 THEN 'beauty' ELSE 'other' END AS item_type,
  'https://www.example.com/s?k=' || replace(replace(p_brand, '#', '%23') || '%20' || p_name, ' ', '%20') AS link FROM part"""
)
def item_types(spark: SparkSession, d: str) -> DataFrame:
    """An item's type by the first group of words that it has, and a shop's search address for it."""
    raw = F.get(F.array(*map(F.lit, ["Zapatillas", "Gafas de sol", "Cámara", "Sofá cama", "Perfume", "cosa"])), (c("p_size") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", links.item_type(raw, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("item_type"), links.search_link("https://www.example.com/s?k=", F.concat_ws(" ", "p_brand", "p_name")).alias("link"))


@query("SELECT p_partkey, p_size < 10 OR (p_size >= 20)::INT + (p_size >= 30)::INT + (p_size >= 40)::INT >= 3 AS escalate FROM part")
def escalations(spark: SparkSession, d: str) -> DataFrame:
    """Whether the fields found lack an essential one, or three desirable ones."""
    wanted = [F.lit(x) for x in extraction.DESIRABLE]
    missing = F.when(c("p_size") >= 20, 1).otherwise(0) + F.when(c("p_size") >= 30, 1).otherwise(0) + F.when(c("p_size") >= 40, 1).otherwise(0)
    essential = F.when(c("p_size") < 10, F.array(*map(F.lit, extraction.ESSENTIAL[1:])).cast("array<string>")).otherwise(F.array(*map(F.lit, extraction.ESSENTIAL)))
    fields = F.concat(essential, F.slice(F.array(*wanted), missing + 1, F.lit(len(wanted))))
    return table(spark, d, "part").select("p_partkey", extraction.needs_escalation(fields).alias("escalate"))


@query("SELECT item_id, list_reduce(list_prepend(5381::BIGINT, list_transform(range(1, 9), lambda i: ascii(substr(text, i::INT, 1))::BIGINT)), lambda h, x: (h * 33 + x) % 4294967296) AS bucket FROM (SELECT item_id, left(text, 8) AS text FROM benchmark WHERE length(text) >= 8)")
def query_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A rolling hash of a query's first characters, as 32 bits."""
    codes = F.transform(F.split(F.substring("text", 1, 8), ""), lambda ch: F.ascii(ch).cast("long"))
    rolled = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, x: F.pmod(h * 33 + x, F.lit(1 << 32)))
    return table(spark, d, "benchmark").where("length(text) >= 8").select("item_id", rolled.alias("bucket"))


@query(
    sql(
        """+ base AS (SELECT job_id, item_no, name FROM items WHERE item_no < 5), delta AS (SELECT DISTINCT job_id FROM jobs WHERE status = 'queued')
SELECT job_id, item_no, name FROM base WHERE job_id NOT IN (SELECT job_id FROM delta) UNION ALL SELECT job_id, 0, 'replaced' FROM delta""",
        "items",
        "jobs",
    )
)
def replaced_children(spark: SparkSession, d: str) -> DataFrame:
    """Children of the jobs at hand replaced as a whole, the others as they were."""
    base = view(spark, d, "items").where("item_no < 5").select("job_id", "item_no", "name")
    delta = view(spark, d, "jobs").where("status = 'queued'").select("job_id").distinct()
    new = delta.select("job_id", F.lit(0).alias("item_no"), F.lit("replaced").alias("name"))
    return base.join(delta, "job_id", "left_anti").unionByName(new)


@query("SELECT event_type, sum(n)::BIGINT AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'view', 5 UNION ALL SELECT 'fresh', 2) GROUP BY event_type")
def counter_rows(spark: SparkSession, d: str) -> DataFrame:
    """Several rows inserted at once into a table of counters."""
    base = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    row = lambda k, n: F.struct(F.lit(k).alias("event_type"), F.lit(n).cast("long").alias("n"))
    delta = spark.range(1).select(F.inline(F.array(row("view", 5), row("fresh", 2))))
    return upserts.additive_upsert(base, delta, ["event_type"], ["n"])


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k, CASE WHEN (props->>'$.k')::INTEGER > 50 THEN least(1, (props->>'$.k')::INTEGER * 3 / 100) WHEN (props->>'$.k')::INTEGER > 1 THEN (props->>'$.k')::INTEGER / 100 ELSE (props->>'$.k')::INTEGER END::DOUBLE AS confidence FROM events")
def coerced_output(spark: SparkSession, d: str) -> DataFrame:
    """Model output repaired and coerced: fences and a trailing comma go, a scale of 0 to 100 becomes 0 to 1, values stay within it."""
    raw = F.concat(F.lit('```json\n{"items": [{"confidence": "'), F.get_json_object("props", "$.k"), F.lit('"},], "k": '), F.get_json_object("props", "$.k"), F.lit(",}\n```"))
    doc = links.model_json(raw)
    k = F.variant_get(doc, "$.k", "int")
    stated = F.variant_get(doc, "$.items[0].confidence", "double")
    return table(spark, d, "events").select("event_id", k.alias("k"), links.unit_scale(F.when(k > 50, stated * 3).otherwise(stated)).alias("confidence"))
