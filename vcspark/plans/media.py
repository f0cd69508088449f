"""Queries on frames, tracks, links and texts of media, and on stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vcspark.functions import geometry, links, taxonomy
from vcspark.functions import text as texts
from vcspark.operators import detections as det
from vcspark.operators import timeline
from vcspark.plans.entities import sql, view
from vcspark.plans.registry import query, table

c = F.col
_SECONDS = "round(epoch(ts) % 86400, 3)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """events as frames: a video is a user's day, a frame's time the second of the day."""
    at = F.round(F.pmod(F.unix_micros(c("ts").cast("timestamp")) / 1e6, F.lit(86400.0)), 3)
    return table(spark, d, "events").select("event_id", F.concat(c("user_id"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("video"), at.alias("sec"), "event_type", "value")


_FRAMES = f"f AS (SELECT event_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS video, {_SECONDS} AS sec, event_type, value FROM events)"


@query(f"WITH {_FRAMES} SELECT event_id, video, sum(CASE WHEN p IS NULL OR abs(value - p) / 1000 >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY sec, event_id)::BIGINT AS scene FROM (SELECT *, lag(value) OVER (PARTITION BY video ORDER BY sec, event_id) AS p FROM f)")
def scene_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A new scene where a frame differs by a tenth or more from the one before."""
    order = Window.partitionBy("video").orderBy("sec", "event_id")
    before = F.lag("value").over(order)
    frames = _frames(spark, d).withColumn("new", (before.isNull() | (F.abs(c("value") - before) / 1000 >= 0.1)).cast("int"))
    return frames.select("event_id", "video", F.sum("new").over(order).alias("scene"))


@query(f"WITH {_FRAMES}, m AS (SELECT video, max(sec) AS newest FROM f GROUP BY video) SELECT video, event_type, sec, max(event_id) AS event_id FROM f JOIN m USING (video) WHERE sec >= greatest(0, newest - 120) GROUP BY video, event_type, sec")
def frame_cache(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each video's last 120 seconds, the last of those with one identity."""
    frames = _frames(spark, d)
    newest = frames.groupBy("video").agg(F.max("sec").alias("newest"))
    return frames.join(newest, "video").where(c("sec") >= F.greatest(F.lit(0.0), c("newest") - 120)).groupBy("video", "event_type", "sec").agg(F.max("event_id").alias("event_id"))


@query(f"WITH {_FRAMES}, p AS (SELECT video, median(sec) AS up_to FROM f WHERE event_type = 'view' GROUP BY video) SELECT event_id, video, sec FROM f LEFT JOIN p USING (video) WHERE up_to IS NULL OR sec > up_to")
def unprocessed_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames past their video's checkpoint, all where there is none."""
    frames = _frames(spark, d)
    done = frames.where("event_type = 'view'").groupBy("video").agg(F.median("sec").alias("up_to"))
    return frames.join(done, "video", "left").where(c("up_to").isNull() | (c("sec") > c("up_to"))).select("event_id", "video", "sec")


@query(f"WITH {_FRAMES} SELECT video, event_type, arg_min(event_id, abs(sec - 43200) * 1000000000 + event_id) AS event_id FROM f GROUP BY video, event_type")
def nearest_appearance(spark: SparkSession, d: str) -> DataFrame:
    """Each product's appearance nearest to noon, the earlier on a tie."""
    return _frames(spark, d).groupBy("video", "event_type").agg(F.min(F.struct(F.abs(c("sec") - 43200).alias("gap"), "event_id")).alias("m")).select("video", "event_type", "m.event_id")


@query(f"WITH {_FRAMES}, s AS (SELECT video, min(sec) AS a, min(sec) + 600 AS b, max(sec) - 600 AS x, max(sec) AS y FROM f WHERE event_type = 'click' GROUP BY video) SELECT event_id, coalesce(sec >= a - 0.25 AND sec <= b + 0.25 OR sec >= x - 0.25 AND sec <= y + 0.25, false) AS inside FROM f LEFT JOIN s USING (video)")
def inside_segments(spark: SparkSession, d: str) -> DataFrame:
    """Whether a frame lies in one of its video's segments, with a quarter second to spare."""
    frames = _frames(spark, d)
    part = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))
    parts = frames.where("event_type = 'click'").groupBy("video").agg(F.array(part(F.min("sec"), F.min("sec") + 600), part(F.max("sec") - 600, F.max("sec"))).alias("parts"))
    return frames.join(parts, "video", "left").select("event_id", F.coalesce(timeline.in_segments(c("sec"), c("parts")), F.lit(False)).alias("inside"))


@query(f"WITH {_FRAMES}, a AS (SELECT video, max_by(sec, event_id) AS m, max_by(event_type, event_id) AS t FROM f GROUP BY video) SELECT event_id, t = event_type AND abs(sec - m) * 1000 <= 80 AS current FROM f JOIN a USING (video)")
def stale_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer is for the active session's frame and moment, within 80 ms."""
    frames = _frames(spark, d)
    active = frames.groupBy("video").agg(F.max_by("sec", "event_id").alias("m"), F.max_by("event_type", "event_id").alias("t"))
    return frames.join(active, "video").select("event_id", ((c("t") == c("event_type")) & (F.abs(c("sec") - c("m")) * 1000 <= 80)).alias("current"))


@query(
    f"""WITH {_FRAMES}, e AS (SELECT event_id % 500 AS id, 0 AS source, event_id AS seq, value FROM f WHERE event_id % 2 = 0 UNION ALL SELECT event_id % 500, 1, event_id, value FROM f WHERE event_id % 2 = 1)
SELECT id, arg_max(seq, source * 1000000000000 + seq) AS seq FROM e GROUP BY id"""
)
def merged_logs(spark: SparkSession, d: str) -> DataFrame:
    """The last entry of each id, those in memory (odd here) over those stored."""
    rows = _frames(spark, d).select((c("event_id") % 500).alias("id"), (c("event_id") % 2).alias("source"), c("event_id").alias("seq"))
    return rows.groupBy("id").agg(F.max(F.struct("source", "seq")).alias("m")).select("id", "m.seq")


@query(
    f"""WITH {_FRAMES}, b AS (SELECT video, max_by(sec, value * 1000000 + event_id) AS best FROM f GROUP BY video)
SELECT event_id, length(repeat('x', (value * 100)::INT)) * 0.75 <= 20000 AND abs(sec - best) <= 0.06 AS attached FROM f JOIN b USING (video) WHERE event_type IN ('click', 'view')"""
)
def attach_crops(spark: SparkSession, d: str) -> DataFrame:
    """Whether a client's crop belongs to its track's best moment and isn't too large."""
    frames = _frames(spark, d)
    best = frames.groupBy("video").agg(F.max_by("sec", c("value") * 1000000 + c("event_id")).alias("best"))
    size = F.length(F.repeat(F.lit("x"), F.round(c("value") * 100).cast("int"))) * 0.75
    return frames.where("event_type in ('click', 'view')").join(best, "video").select("event_id", ((size <= 20000) & (F.abs(c("sec") - c("best")) <= 0.06)).alias("attached"))


@query(f"WITH {_FRAMES} SELECT event_id, CASE WHEN sec::INT // 3600 > 0 THEN (floor(sec)::INT // 3600) || ':' || lpad((floor(sec)::INT % 3600 // 60)::VARCHAR, 2, '0') ELSE (floor(sec)::INT % 3600 // 60)::VARCHAR END || ':' || lpad((floor(sec)::INT % 60)::VARCHAR, 2, '0') AS shown FROM (SELECT event_id, floor(sec) AS sec FROM f)")
def timestamp_format(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d).select("event_id", texts.timestamp(c("sec")).alias("shown"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, 'page=([0-9]+)|/([0-9]+)', 0), ''), '') <> '' AS numbered, length(url)::INTEGER AS length FROM pages")
def slim_pages(spark: SparkSession, d: str) -> DataFrame:
    """A slim projection: two facts of each address, without the page itself."""
    return table(spark, d, "pages").select("page_id", c("url").rlike("page=[0-9]+|/[0-9]+").alias("numbered"), F.length("url").alias("length"))


_VIDEO = "CASE {0} % 7 WHEN 0 THEN 'https://www.youtube.com/watch?v=abcdefghi' || lpad(({0} % 100)::VARCHAR, 2, '0') WHEN 1 THEN 'youtu.be/ABCDEFGHI' || lpad(({0} % 100)::VARCHAR, 2, '0') || '?t=3' WHEN 2 THEN 'https://m.youtube.com/shorts/x-_defghi' || lpad(({0} % 100)::VARCHAR, 2, '0') WHEN 3 THEN 'https://vimeo.com/' || {0} WHEN 4 THEN 'abcdefghi' || lpad(({0} % 100)::VARCHAR, 2, '0') WHEN 5 THEN 'https://youtube.com/live/short' ELSE '' END"


@query(f"SELECT event_id, CASE WHEN event_id % 7 IN (0, 4) THEN 'abcdefghi' WHEN event_id % 7 = 1 THEN 'ABCDEFGHI' WHEN event_id % 7 = 2 THEN 'x-_defghi' END || lpad((event_id % 100)::VARCHAR, 2, '0') AS video_id, CASE WHEN event_id % 7 IN (0, 1, 2, 5) THEN 'youtube' WHEN event_id % 7 = 3 THEN 'vimeo' END AS provider FROM events")
def video_links(spark: SparkSession, d: str) -> DataFrame:
    """Provider and YouTube id of links in several shapes."""
    two = F.lpad((c("event_id") % 100).cast("string"), 2, "0")
    shape = lambda head, tail="": F.concat(F.lit(head), two, F.lit(tail))
    made = [shape("https://www.youtube.com/watch?v=abcdefghi"), shape("youtu.be/ABCDEFGHI", "?t=3"), shape("https://m.youtube.com/shorts/x-_defghi"), F.concat(F.lit("https://vimeo.com/"), c("event_id")), shape("abcdefghi"), F.lit("https://youtube.com/live/short"), F.lit("")]
    url = F.array(*made)[(c("event_id") % 7).cast("int")]
    return table(spark, d, "events").select("event_id", links.youtube_id(url).alias("video_id"), links.video_provider(url).alias("provider"))


@query(
    sql(
        """SELECT job_id, item_no, 'job' || job_id || '|' || trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) || '|' || CASE category WHEN 'Decoración' THEN 'decoracion' ELSE lower(category) END || '|_|' || coalesce(lower(pattern), '_') || '|' || coalesce(lower(visible_brand), '_') || '|' || (floor(item_no * 3.7::DOUBLE / 5) * 5)::INT AS fingerprint FROM items""",
        "items",
    )
)
def item_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    print_of = links.item_fingerprint(F.concat(F.lit("job"), "job_id"), c("name"), c("category"), F.lit(None).cast("string"), c("pattern"), c("visible_brand"), texts.time_bucket(c("item_no") * 3.7))
    return view(spark, d, "items").select("job_id", "item_no", print_of.alias("fingerprint"))


@query(
    sql(
        """+ t AS (SELECT query_id, pos, CASE pos % 4 WHEN 0 THEN 'desde ' || price::INT || ',50 €' WHEN 1 THEN '$' || (price::INT // 1000) || '.' || lpad((price::INT % 1000)::VARCHAR, 3, '0') WHEN 2 THEN 'n/a' ELSE (price::INT)::VARCHAR END AS raw, price::INT AS p FROM candidates WHERE price IS NOT NULL AND price >= 1000)
SELECT query_id, pos, CASE pos % 4 WHEN 0 THEN p + 0.5 WHEN 1 THEN p WHEN 3 THEN p END::DOUBLE AS price, CASE pos % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS currency FROM t""",
        "candidates",
    )
)
def section_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices in result sections: dots before three digits are thousands, a comma is the decimal sign."""
    whole = F.rint("price").cast("int")
    raw = F.when(c("pos") % 4 == 0, F.concat(F.lit("desde "), whole, F.lit(",50 €"))).when(c("pos") % 4 == 1, F.concat(F.lit("$"), F.floor(whole / 1000).cast("int"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))).when(c("pos") % 4 == 2, "n/a").otherwise(whole.cast("string"))
    return view(spark, d, "candidates").where("price >= 1000").select("query_id", "pos", texts.section_price(raw).alias("price"), texts.section_currency(raw).alias("currency"))


@query(
    sql(
        """SELECT job_id, item_no, greatest(0, least(1, person_score - 0.1)) AS x, least(area, 1) AS width, area >= 0.7 AS covers, area * 1000 >= 200 AND area * area >= 0.02 AS searchable FROM (SELECT job_id, item_no, coalesce(person_score, 0.2) AS person_score, area FROM items)""",
        "items",
    )
)
def box_rules(spark: SparkSession, d: str) -> DataFrame:
    """Clamped boxes, whether one covers most of the frame, and whether a crop is large enough to search."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("person_score", F.lit(0.2)) - 0.1))
    b = geometry.box(F.lit(0.0), F.lit(0.0), c("area"), F.lit(1.0))
    return view(spark, d, "items").select("job_id", "item_no", x.alias("x"), F.least("area", F.lit(1.0)).alias("width"), geometry.covers_frame(b).alias("covers"), ((c("area") * 1000 >= 200) & (c("area") * c("area") >= 0.02)).alias("searchable"))


@query(sql("SELECT relationship, string_agg(DISTINCT lower(name), '/' ORDER BY lower(name)) AS names FROM items GROUP BY relationship", "items"))
def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "items").groupBy("relationship").agg(F.array_join(F.array_sort(F.collect_set(F.lower("name"))), "/").alias("names"))


@query(sql("SELECT job_id, product_id, min(item_no) AS item_no FROM items GROUP BY job_id, product_id, pattern, logo_visible", "items"))
def variant_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row of each variant (product, pattern, logo), the first."""
    return view(spark, d, "items").groupBy("job_id", "product_id", "pattern", "logo_visible").agg(F.min("item_no").alias("item_no")).select("job_id", "product_id", "item_no")


@query(sql("SELECT product_id, max(image_url) AS image, max(score) AS width, min(price) AS best_price, max(price) AS list_price FROM candidates GROUP BY product_id", "candidates"))
def best_offer(spark: SparkSession, d: str) -> DataFrame:
    """The widest picture of a product, its lowest price and highest list price."""
    return view(spark, d, "candidates").groupBy("product_id").agg(F.max("image_url").alias("image"), F.max("score").alias("width"), F.min("price").alias("best_price"), F.max("price").alias("list_price"))


@query(
    sql(
        """+ u AS (SELECT query_id, link AS k, source, score / 180 AS s, title FROM candidates)
SELECT query_id, k AS link, source, s AS score FROM u QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY s DESC, source, title) = 1""",
        "candidates",
    )
)
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue and outside results in one, the best of each product; the catalogue wins ties."""
    rows = view(spark, d, "candidates").select("query_id", "link", "source", (c("score") / 180).alias("score"), "title")
    catalogue, outside = rows.where("source = 'catalog'"), rows.where("source = 'external'")
    order = [F.desc("score"), c("source"), c("title")]
    return det.top_per_group(catalogue.unionByName(outside), ["query_id", "link"], order, 1, "n").select("query_id", "link", "source", "score")


@query("SELECT vec_id, label, len(embedding)::INTEGER AS dimension FROM embeddings")
def public_payload(spark: SparkSession, d: str) -> DataFrame:
    """What may be shown of a product: all but its vectors."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("dimension"))


@query("SELECT p_partkey AS id, p_name AS title, upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS kind, nullif(p_type, 'LARGE') AS category, 'EUR' AS currency, CASE WHEN p_retailprice > 0 THEN p_retailprice END AS price, p_brand || ' ' || p_name AS full_title FROM part")
def dataset_projection(spark: SparkSession, d: str) -> DataFrame:
    """Product rows from dataset rows: a title is composed, and what isn't stated stays null."""
    kind = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2)))
    return table(spark, d, "part").select(
        c("p_partkey").alias("id"), c("p_name").alias("title"), kind.alias("kind"), F.nullif("p_type", F.lit("LARGE")).alias("category"), F.lit("EUR").alias("currency"),
        F.when(c("p_retailprice") > 0, c("p_retailprice")).alias("price"), F.concat_ws(" ", "p_brand", "p_name").alias("full_title"),
    )


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'URGENT' ELSE substr(o_orderpriority, 3) END AS priority, CASE WHEN o_custkey % 5 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS total FROM orders")
def sparse_patch(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the allow-listed columns that a patch states; null there says nothing."""
    base = table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 3, 100).alias("priority"), c("o_totalprice").alias("total"))
    patch = table(spark, d, "orders").where("o_custkey % 3 = 0 or o_custkey % 5 = 0").select("o_orderkey", F.when(c("o_custkey") % 3 == 0, "URGENT").alias("p_priority"), F.when(c("o_custkey") % 5 == 0, 0.0).alias("p_total"))
    return base.join(patch, "o_orderkey", "left").select("o_orderkey", F.coalesce("p_priority", "priority").alias("priority"), F.coalesce("p_total", "total").alias("total"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END AS state FROM events")
def nested_update(spark: SparkSession, d: str) -> DataFrame:
    """A nested field set and another removed, in a struct of what JSON says."""
    doc = F.struct(F.from_json("props", "k long").alias("props"), F.lit("pending").alias("state"), c("value").alias("value"))
    rows = table(spark, d, "events").select("event_id", doc.withField("state", F.when(c("event_type") == "error", "failed").otherwise("ready")).dropFields("value").alias("doc"))
    return rows.select("event_id", "doc.props.k", "doc.state")


@query(
    "WITH t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/+|/+$', '', 'g'), '/') AS parts FROM pages), u AS (SELECT host, regexp_replace(array_to_string(parts, '/'), '[0-9]+', '#', 'g') AS shape, length(parts[len(parts)]) AS last FROM t)"
    " SELECT host, shape, count(*) AS n, min(last)::INTEGER AS shortest, max(last)::INTEGER AS longest FROM u GROUP BY host, shape"
)
def url_token_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of each host's addresses, digits folded, with the lengths of their last part."""
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1), "^/+|/+$", "")
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_replace(path, "[0-9]+", "#").alias("shape"), F.length(F.element_at(F.split(path, "/"), -1)).alias("last"))
    return rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("last").alias("shortest"), F.max("last").alias("longest"))


def _styled(x: Column) -> Column:
    return links.style_bucket(x)


@query(
    "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'streetwear' WHEN 1 THEN 'luxury' WHEN 2 THEN 'sport' WHEN 3 THEN 'home decor' WHEN 4 THEN 'formal' END AS style FROM part"
)
def style_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The style that a text's words stand for, by the first group that has one."""
    raw = F.get(F.array(*map(F.lit, ["Urban look", "muy Elegante", "ropa deportiva", "muebles de interior", "Business", "nothing known"])), (c("p_size") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", _styled(raw).alias("style"))


@query("SELECT p_partkey, p_brand, p_name FROM part WHERE trim(regexp_replace(lower(p_brand), '[^a-z0-9\\s]', ' ', 'g')) = 'brand 4'")
def brand_filter(spark: SparkSession, d: str) -> DataFrame:
    """Products of one brand, by its canonical name."""
    return table(spark, d, "part").where(taxonomy.canonical_brand("p_brand") == "brand 4").select("p_partkey", "p_brand", "p_name")


@query("WITH g AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Women' WHEN 1 THEN 'men' WHEN 2 THEN 'Unisex' END AS a, CASE p_partkey % 3 WHEN 0 THEN 'women' WHEN 1 THEN 'men' END AS b FROM part) SELECT p_partkey, coalesce(lower(a) <> lower(b) AND lower(a) <> 'unisex', false) AS conflict FROM g")
def gender_conflicts(spark: SparkSession, d: str) -> DataFrame:
    a = F.get(F.array(F.lit("Women"), F.lit("men"), F.lit("Unisex"), F.lit(None)), (c("p_size") % 4).cast("int"))
    b = F.get(F.array(F.lit("women"), F.lit("men"), F.lit(None)), (c("p_partkey") % 3).cast("int"))
    return table(spark, d, "part").select("p_partkey", taxonomy.gender_conflict(a, b).alias("conflict"))
