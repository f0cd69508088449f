"""Queries on detected items, outside candidates, jobs and connectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.operators import detections as det
from vcspark.operators import routing
from vcspark.plans.entities import sql, view
from vcspark.plans.registry import query

c = F.col


def _any(words: list[str]) -> str:
    return "'" + "|".join(w.replace(".", "\\.") for w in words) + "'"


_HAY = "strip_accents(lower(coalesce(category, '') || ' ' || coalesce(subcategory, '') || ' ' || coalesce(name, '')))"
_PRIORITY = f"""CASE WHEN relationship IN ('worn', 'held', 'used') THEN 'high'
  WHEN coalesce(relationship = 'background', false) OR regexp_matches({_HAY}, {_any(det.LOW_PRIORITY)}) THEN CASE WHEN coalesce(relevance, 0) >= 0.75 THEN 'medium' ELSE 'low' END
  WHEN regexp_matches({_HAY}, {_any(det.HIGH_PRIORITY)}) THEN 'high' ELSE 'medium' END"""
_DISTINCT = "(coalesce(pattern, '') <> '' AND NOT regexp_matches(pattern, '(?i)^(liso|plain|solid)$'))"
_PREMIUM = f"(regexp_matches(lower(coalesce(category, '') || ' ' || coalesce(subcategory, '')), {_any(det.PREMIUM)}) OR visible_brand IS NOT NULL OR logo_visible AND confidence >= 0.6 OR visible_text IS NOT NULL OR {_DISTINCT} OR coalesce(relevance, 0) >= 0.85)"
_KEYWORDS = {"footwear": ["sneaker", "calzado", "shoe"], "watches_jewelry": ["reloj", "watch", "ring"], "decoration": ["decoracion", "planta", "vase"]}


def _priority() -> Column:
    return det.presentation_priority(c("category"), c("subcategory"), c("name"), c("relationship"), c("relevance"))


def _premium() -> Column:
    return det.premium_item(c("category"), c("subcategory"), c("visible_brand"), c("logo_visible"), c("visible_text"), c("pattern"), c("confidence"), c("relevance"))


@query(sql("SELECT job_id, item_no, name FROM items WHERE category = 'Ropa' AND confidence >= 0.5 AND frame_id IN (1, 2, 3)", "items"))
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """Predicates that are given apply, the null one (a brand) asks nothing."""
    asked = {"category": ("eqNullSafe", "Ropa"), "confidence": ("__ge__", 0.5), "frame_id": ("isin", [1, 2, 3]), "brand": ("eqNullSafe", None)}
    return det.optional_filters(view(spark, d, "items"), **asked).select("job_id", "item_no", "name")


@query(sql("SELECT job_id, owner_id, status FROM jobs WHERE (CASE WHEN owner_id % 2 = 0 THEN 'running' END IS NULL OR status = 'running')", "jobs"))
def null_or_equal(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(c("owner_id") % 2 == 0, "running")
    return view(spark, d, "jobs").where(det.null_or_equal(c("status"), asked)).select("job_id", "owner_id", "status")


@query(sql("SELECT query_id, pos, image_url IS NOT NULL OR exact AND store IS NOT NULL AS presentable FROM candidates", "candidates"))
def presentable_image(spark: SparkSession, d: str) -> DataFrame:
    images = F.array(F.struct(F.lit(None).cast("string").alias("url")), F.struct(F.when(c("exact"), c("store")).alias("url")))
    return view(spark, d, "candidates").select("query_id", "pos", det.presentable(c("image_url"), images).alias("presentable"))


@query(sql("SELECT job_id, item_no, category FROM items WHERE (lower(category) IN ('ropa', 'bolso') OR coalesce(lower(subcategory), '') IN ('ropa', 'bolso')) AND coalesce(lower(relationship), '') IN ('worn', 'held')", "items"))
def dataset_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = det.dataset_row_wanted(c("category"), c("subcategory"), c("relationship"), ["ROPA", "Bolso"], ["Worn", "held"])
    return view(spark, d, "items").where(wanted).select("job_id", "item_no", "category")


@query(sql(f"SELECT job_id, item_no, name FROM items WHERE regexp_matches({_HAY}, 'reloj|watch|ring|decoracion|planta|vase')", "items"))
def category_keywords(spark: SparkSession, d: str) -> DataFrame:
    allowed = det.category_allowed(c("category"), c("subcategory"), c("name"), _KEYWORDS, ["watches_jewelry", "decoration"])
    return view(spark, d, "items").where(allowed).select("job_id", "item_no", "name")


@query(sql("SELECT job_id, item_no, relationship FROM items WHERE coalesce(relationship, 'near_person') = 'worn' OR coalesce(relationship, 'near_person') IN ('held', 'near_person')", "items"))
def relationship_filter(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "items").where(det.relationship_allowed(c("relationship"), True, ["footwear"])).select("job_id", "item_no", "relationship")


_COMMERCIAL = f"""regexp_matches(link, '(?i)^https?://[^/]') AND NOT regexp_matches(lower(coalesce(domain, regexp_extract(link, '^[a-zA-Z]+://([^/:?#]+)', 1))), {_any(det.NON_COMMERCE_HOSTS)})
  AND NOT regexp_matches(title, '(?i)\\b(interview|biograf[ií]a|review|news)\\b') AND (price IS NOT NULL OR store IS NOT NULL OR brand IS NOT NULL)"""


@query(sql(f"SELECT query_id, pos, link FROM candidates WHERE {_COMMERCIAL}", "candidates"))
def commercial_gate(spark: SparkSession, d: str) -> DataFrame:
    gate = det.commercial_candidate(c("link"), c("domain"), c("title"), c("price"), c("store"), c("brand"))
    return view(spark, d, "candidates").where(gate).select("query_id", "pos", "link")


_SELLS = f"NOT coalesce(regexp_matches(domain, {_any(det.NON_COMMERCIAL_DOMAINS)}), false)"
_COMM = f"({_SELLS} AND (price IS NOT NULL OR source_type IN ('products', 'shopping') OR brand IS NOT NULL))"
_USEFUL = f"({_COMM} OR {_SELLS} AND image_url IS NOT NULL)"
_SIGNALS = {"domain": "domain", "price": "price", "source_type": "source_type", "brand": "brand", "image_url": "image_url", "exact": "exact"}


@query(sql(f"SELECT query_id, pos, {_COMM} AS commercial, {_USEFUL} AS useful FROM candidates", "candidates"))
def useful_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = det.result_signals(**{k: c(v) for k, v in _SIGNALS.items()})
    return view(spark, d, "candidates").select("query_id", "pos", s["commercial"].alias("commercial"), s["useful"].alias("useful"))


@query(
    sql(
        f"""+ n AS (SELECT query_id, count(*) FILTER (WHERE {_USEFUL}) AS useful_count, count(*) FILTER (WHERE {_COMM}) AS commercial_count, count(*) FILTER (WHERE {_COMM} AND exact) AS exact_count FROM candidates GROUP BY query_id),
q AS (SELECT *, least(1, commercial_count * 0.15::DOUBLE + exact_count * 0.4::DOUBLE + useful_count * 0.05::DOUBLE) AS s FROM n),
r AS (SELECT *, CASE WHEN useful_count < 1 THEN 'no_useful_results' WHEN s < 0.25 THEN 'weak_results' END AS fallback_reason FROM q)
SELECT query_id, useful_count, commercial_count, exact_count, round(s, 6) AS quality, fallback_reason IS NOT NULL AS should_fallback, fallback_reason FROM r""",
        "candidates",
    )
)
def result_quality(spark: SparkSession, d: str) -> DataFrame:
    return det.result_quality(view(spark, d, "candidates"), ["query_id"], **{k: c(v) for k, v in _SIGNALS.items()})


@query(sql("SELECT job_id, item_no FROM items WHERE name ILIKE '%relo%' OR visible_brand ILIKE '%#4%'", "items"))
def free_text(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "items").where(c("name").ilike("%relo%") | c("visible_brand").ilike("%#4%")).select("job_id", "item_no")


@query(sql("SELECT job_id, status FROM (SELECT job_id, CASE status WHEN 'queued' THEN 'review_required' WHEN 'running' THEN 'published' ELSE 'detected' END AS status FROM jobs) WHERE status NOT IN ('detected', 'external_candidate', 'review_required', 'ignored')", "jobs"))
def validated_items(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(c("status") == "queued", "review_required").when(c("status") == "running", "published").otherwise("detected")
    return view(spark, d, "jobs").select("job_id", status.alias("status")).where(det.validated(c("status")))


@query(
    sql(
        f"""+ p AS (SELECT *, {_PRIORITY} AS priority, {_PREMIUM} AS premium FROM items)
SELECT job_id, item_no, priority, premium, relationship IN ('worn', 'held', 'used') AND relationship IS NOT NULL OR coalesce(relationship <> 'background', true) AND priority <> 'low' AS auto_search,
  priority <> 'low' AND (premium OR priority = 'high' OR {_DISTINCT} OR visible_text IS NOT NULL OR logo_visible OR visible_brand IS NOT NULL OR coalesce(relevance, 0) >= 0.7) AS enrich FROM p""",
        "items",
    )
)
def search_gates(spark: SparkSession, d: str) -> DataFrame:
    """Priority, whether premium, and whether an item is searched and looked at again by itself."""
    rows = view(spark, d, "items").withColumn("priority", _priority()).withColumn("premium", _premium())
    enrich = det.should_enrich(c("priority"), c("premium"), c("pattern"), c("visible_text"), c("logo_visible"), c("visible_brand"), c("relevance"))
    return rows.select("job_id", "item_no", "priority", "premium", det.deserves_auto_search(c("priority"), c("relationship")).alias("auto_search"), enrich.alias("enrich"))


@query(sql("+ f AS (SELECT job_id, max(confidence) < 0.45 OR NOT bool_or(category = 'Ropa') AS n FROM items GROUP BY job_id) SELECT jobs.job_id, coalesce(n, true) AS needed FROM jobs LEFT JOIN f ON f.job_id = jobs.job_id", "items", "jobs"))
def detector_fallback(spark: SparkSession, d: str) -> DataFrame:
    return det.fallback_needed(view(spark, d, "items"), view(spark, d, "jobs"), "job_id", [c("category") == "Ropa"])


@query(
    sql(
        """+ p AS (SELECT job_id, item_no, category FROM items WHERE logo_visible), f AS (SELECT job_id, item_no, upper(category) AS category FROM items WHERE NOT logo_visible)
SELECT * FROM p UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.job_id = f.job_id AND lower(trim(p.category)) = lower(trim(f.category)))""",
        "items",
    )
)
def fallback_union(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "items").select("job_id", "item_no", "category", "logo_visible")
    return det.with_fallback(items.where("logo_visible").drop("logo_visible"), items.where("not logo_visible").drop("logo_visible").withColumn("category", F.upper("category")), "job_id", "category")


_ASSOC = f"""CASE WHEN person_score IS NOT NULL THEN least(1, greatest(0, person_score)) WHEN relationship IS NOT NULL THEN CASE relationship WHEN 'worn' THEN 1.0 WHEN 'held' THEN 0.95 WHEN 'used' THEN 0.8 WHEN 'near_person' THEN 0.55 ELSE 0.15 END
  WHEN regexp_matches({_HAY}, {_any(det.WEARABLE)}) THEN 0.9 ELSE 0.5 END"""
_BUY = f"CASE WHEN regexp_matches(lower(category), {_any(det.BUYABLE_HIGH)}) THEN 1.0 WHEN regexp_matches(lower(category), {_any(det.BUYABLE_MID)}) THEN 0.7 ELSE 0.5 END"


@query(
    sql(
        f"""+ s AS (SELECT frame_id, job_id, item_no, round({_ASSOC}::DOUBLE * 0.45 + coalesce(relevance, {_BUY}::DOUBLE * 0.8) * 0.25 + least(1, area * 4) * confidence * 0.2
    + CASE WHEN logo_visible OR visible_text IS NOT NULL OR {_DISTINCT} THEN 1.0 ELSE 0.3 END::DOUBLE * 0.1 + CASE WHEN coalesce(relationship = 'background', false) OR {_PRIORITY} = 'low' THEN -0.3 ELSE 0 END::DOUBLE, 6) AS score
  FROM items WHERE confidence >= 0.2)
SELECT frame_id, job_id, item_no, score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, job_id, item_no)::INTEGER AS rank FROM s QUALIFY rank <= 15""",
        "items",
    )
)
def person_centric_top(spark: SparkSession, d: str) -> DataFrame:
    """The 15 best items of each frame by the person-centred score."""
    association = det.person_association(c("person_score"), c("relationship"), c("category"), c("subcategory"), c("name"))
    distinctive = c("logo_visible") | c("visible_text").isNotNull() | det.distinctive_pattern(c("pattern"))
    score = det.composite_score(association, F.coalesce("relevance", det.buyability(c("category")) * 0.8), c("area"), c("confidence"), distinctive, c("relationship"), _priority())
    scored = view(spark, d, "items").where("confidence >= 0.2").select("frame_id", "job_id", "item_no", F.round(score, 6).alias("score"))
    return det.top_per_group(scored, ["frame_id"], [F.desc("score"), c("job_id"), c("item_no")], 15)


@query(sql(f"+ p AS (SELECT job_id, item_no, {_PRIORITY} AS priority FROM items) SELECT job_id, item_no, priority, row_number() OVER (PARTITION BY job_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, item_no, priority)::INTEGER AS place FROM p", "items"))
def presentation_order(spark: SparkSession, d: str) -> DataFrame:
    """Items of a job by priority, their own order within one."""
    rows = view(spark, d, "items").select("job_id", "item_no", _priority().alias("priority"))
    level = F.when(c("priority") == "high", 0).when(c("priority") == "medium", 1).otherwise(2)
    return det.top_per_group(rows, ["job_id"], [level, c("item_no"), c("priority")], 1 << 30, "place")


@query(
    sql(
        """+ k AS (SELECT lower(category) AS k, count(*) AS n FROM items WHERE logo_visible GROUP BY 1), m AS (SELECT greatest(1, max(n)) AS most FROM k)
SELECT job_id, item_no, round(confidence + CASE WHEN contains(lower(category), 'ropa') THEN 0.4::DOUBLE WHEN contains(lower(category), 'accesorio') THEN 0.24::DOUBLE ELSE 0 END + coalesce(n, 0) / most * 0.3::DOUBLE, 6) AS score
FROM items LEFT JOIN k ON k = lower(category) CROSS JOIN m""",
        "items",
    )
)
def personal_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Score, boost of the frame's style for the category, and the user's clicks by category, relative to the most."""
    items = view(spark, d, "items")
    clicks = items.where("logo_visible").groupBy(F.lower("category").alias("k")).count()
    most = clicks.agg(F.greatest(F.lit(1), F.coalesce(F.max("count"), F.lit(1))).alias("most"))
    # a row for each category, and one row
    joined = items.join(F.broadcast(clicks), F.lower("category") == c("k"), "left").join(F.broadcast(most))
    boost = F.when(F.contains(F.lower("category"), F.lit("ropa")), 5).when(F.contains(F.lower("category"), F.lit("accesorio")), 3).otherwise(0) / 5
    return joined.select("job_id", "item_no", F.round(c("confidence") + boost * 0.4 + F.coalesce("count", F.lit(0)) / c("most") * 0.3, 6).alias("score"))


@query(
    sql(
        """+ k AS (SELECT query_id, pos, product_id, bool_or(exact) AS exact, max(brand) AS brand, max(store) AS store, max(price) AS price FROM candidates GROUP BY query_id, pos, product_id),
p AS (SELECT query_id, pos, product_id, unnest([{'p': CASE WHEN exact THEN 100 ELSE 0 END, 'i': 1, 'l': 'Same picture'}, {'p': CASE WHEN brand IS NOT NULL THEN 40 ELSE 0 END, 'i': 2, 'l': 'Brand'}, {'p': CASE WHEN store IS NOT NULL THEN 30 ELSE -20 END, 'i': 3, 'l': 'Shop'}, {'p': CASE WHEN price IS NOT NULL THEN 30 ELSE 0 END, 'i': 4, 'l': 'Shop'}]) AS e FROM k)
SELECT query_id, pos, product_id, array_to_string(list(e.l ORDER BY -e.p, e.i), '/') AS lines FROM (SELECT * FROM p WHERE e.p <> 0 QUALIFY row_number() OVER (PARTITION BY query_id, pos, product_id, e.l ORDER BY -e.p, e.i) = 1) GROUP BY query_id, pos, product_id""",
        "candidates",
    )
)
def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    """Labels of what speaks for a candidate, most points first, each once, in one text."""
    points = {"exact": F.when(c("exact"), 100).otherwise(0), "brand": F.when(c("brand").isNotNull(), 40).otherwise(0), "store": F.when(c("store").isNotNull(), 30).otherwise(-20), "price": F.when(c("price").isNotNull(), 30).otherwise(0)}
    labels = F.create_map(*map(F.lit, ["exact", "Same picture", "brand", "Brand", "store", "Shop", "price", "Shop"]))
    lines = det.evidence_lines(F.create_map(*[x for k, v in points.items() for x in (F.lit(k), v)]), labels)
    keys = ["query_id", "pos", "product_id"]
    rows = view(spark, d, "candidates").groupBy(*keys).agg(F.bool_or("exact").alias("exact"), *[F.max(x).alias(x) for x in ("brand", "store", "price")])
    return rows.select(*keys, F.array_join(lines, "/").alias("lines")).where("lines <> ''")


@query(sql("+ v AS (SELECT query_id, source, pos, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, pos, product_id)::INTEGER AS rank FROM candidates QUALIFY rank <= 3) SELECT query_id, source, pos, score, rank, rank = 1 AND score >= 80 AS selected FROM v", "candidates"))
def visible_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Three candidates for each source; the first is selected if it reaches the threshold."""
    top = det.top_per_group(view(spark, d, "candidates").select("query_id", "source", "pos", "score", "product_id"), ["query_id", "source"], [F.desc("score"), c("pos"), c("product_id")], 3)
    return top.select("query_id", "source", "pos", "score", "rank", ((c("rank") == 1) & (c("score") >= 80)).alias("selected"))


@query(
    sql(
        """+ s AS (SELECT query_id, lower(coalesce(store, domain, 'Tienda')) AS store, score, pos, link FROM candidates WHERE score >= 0),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, store ORDER BY score DESC, pos, link) = 1)
SELECT query_id, store, link, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, link)::INTEGER AS place FROM o QUALIFY place <= 4""",
        "candidates",
    )
)
def top_stores(spark: SparkSession, d: str) -> DataFrame:
    """The four best different shops of each query."""
    rows = view(spark, d, "candidates").where("score >= 0").select("query_id", F.lower(F.coalesce("store", "domain", F.lit("Tienda"))).alias("store"), "score", "pos", "link")
    order = [F.desc("score"), c("pos"), c("link")]
    best = det.top_per_group(rows, ["query_id", "store"], order, 1, "n").drop("n")
    return det.top_per_group(best, ["query_id"], order, 4, "place").select("query_id", "store", "link", "place")


@query(sql("SELECT query_id, pos, score, price, row_number() OVER (PARTITION BY query_id ORDER BY price DESC NULLS LAST, pos, product_id, score)::INTEGER AS place FROM candidates", "candidates"))
def order_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "candidates").select("query_id", "pos", "score", "price", "product_id")
    return det.top_per_group(rows, ["query_id"], [F.desc_nulls_last("price"), c("pos"), c("product_id"), c("score")], 1 << 30, "place").drop("product_id")


@query(
    sql(
        """+ r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, product_id) AS place FROM candidates WHERE score > 0 QUALIFY place <= 5),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price NULLS FIRST, pos, product_id) AS place FROM candidates WHERE source_type = 'shopping' QUALIFY place <= 3)
SELECT query_id, place::INTEGER AS place, title, price, coalesce(currency, CASE WHEN price IS NOT NULL THEN 'EUR' END) AS currency, least(score / 150, 1)::DOUBLE AS similarity, match_type FROM r
UNION ALL SELECT query_id, (place + 5)::INTEGER, title, price, coalesce(currency, 'EUR'), NULL, NULL FROM o""",
        "candidates",
    )
)
def item_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Five ranked candidates and three shopping offers of each query."""
    rows = view(spark, d, "candidates")
    return routing.recommendations(rows, "query_id", [F.desc("score"), c("pos"), c("product_id")], rows.where("source_type = 'shopping'"), [c("price"), c("pos"), c("product_id")])


_BEST = "SELECT query_id, title, score FROM candidates QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, product_id) = 1"


@query(sql(f"+ b AS ({_BEST}) SELECT jobs.job_id, jobs.status, b.title, b.score FROM jobs LEFT JOIN b ON b.query_id = jobs.job_id", "jobs", "candidates"))
def item_with_best(spark: SparkSession, d: str) -> DataFrame:
    """Each job with its best candidate, the first on a tie."""
    rows = view(spark, d, "candidates")
    best = rows.groupBy("query_id").agg(F.min(F.struct((-c("score")).alias("s"), "pos", "product_id", "title", "score")).alias("b"))
    return view(spark, d, "jobs").join(best, c("job_id") == c("query_id"), "left").select("job_id", "status", "b.title", "b.score")


@query(sql("+ r AS (SELECT query_id, array_to_string(list(title ORDER BY price DESC NULLS LAST, pos, product_id), '/') AS titles FROM candidates GROUP BY query_id) SELECT job_id, coalesce(titles, '') AS titles FROM jobs LEFT JOIN r ON query_id = job_id", "jobs", "candidates"))
def item_with_list(spark: SparkSession, d: str) -> DataFrame:
    """Each job with its candidates' titles in order of price, dearest first, unpriced last."""
    entry = F.struct(c("price").isNull().alias("n"), (-c("price")).alias("p"), "pos", "product_id", "title")
    lists = view(spark, d, "candidates").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["title"]), "/").alias("titles"))
    return view(spark, d, "jobs").join(lists, c("job_id") == c("query_id"), "left").select("job_id", F.coalesce("titles", F.lit("")).alias("titles"))


@query(sql("+ v AS (SELECT link, max(score) AS checked FROM candidates WHERE exact GROUP BY link) SELECT query_id, pos, score, checked FROM candidates LEFT JOIN v USING (link)", "candidates"))
def candidate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate with the check of its link."""
    rows = view(spark, d, "candidates")
    checks = rows.where("exact").groupBy("link").agg(F.max("score").alias("checked"))
    return rows.join(checks, "link", "left").select("query_id", "pos", "score", "checked")


@query(sql("SELECT job_id, kind, media_id, j.cost, n.items FROM jobs j JOIN (SELECT media_id, count(*) AS items FROM jobs GROUP BY media_id) n USING (media_id)", "jobs"))
def job_media(spark: SparkSession, d: str) -> DataFrame:
    jobs = view(spark, d, "jobs")
    return jobs.join(jobs.groupBy("media_id").agg(F.count("*").alias("items")), "media_id").select("job_id", "kind", "media_id", "cost", "items")


@query(sql("SELECT media_id, job_id, created_at FROM jobs WHERE status = 'completed' AND cost < 300 QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY created_at DESC, job_id DESC) = 1", "jobs"))
def reusable_job(spark: SparkSession, d: str) -> DataFrame:
    """The latest completed job of each media that may be used again."""
    done = view(spark, d, "jobs").where("status = 'completed' and cost < 300")
    return done.groupBy("media_id").agg(F.max(F.struct("created_at", "job_id")).alias("j")).select("media_id", "j.job_id", "j.created_at")


@query(sql("SELECT i.job_id, i.item_no, j.owner_id, j.kind, 'new' AS state FROM items i JOIN jobs j ON j.job_id = i.job_id AND j.status = 'queued'", "items", "jobs"))
def insert_from_job(spark: SparkSession, d: str) -> DataFrame:
    """Rows to insert for each item of a queued job, with what the job says."""
    queued = view(spark, d, "jobs").where("status = 'queued'").select("job_id", "owner_id", "kind")
    return view(spark, d, "items").select("job_id", "item_no").join(queued, "job_id").withColumn("state", F.lit("new"))


@query(sql("SELECT job_id, EXISTS (SELECT 1 FROM jobs k WHERE k.owner_id = j.owner_id AND k.kind = j.kind AND k.status IN ('queued', 'running') AND k.created_at >= TIMESTAMP '2000-01-01' AND k.job_id < j.job_id) AS active FROM jobs j", "jobs"))
def active_job(spark: SparkSession, d: str) -> DataFrame:
    """Whether the owner has an earlier active job of the same kind."""
    jobs = view(spark, d, "jobs")
    running = jobs.where("status in ('queued', 'running') and created_at >= timestamp'2000-01-01'").groupBy("owner_id", "kind").agg(F.min("job_id").alias("first"))
    return jobs.join(running, ["owner_id", "kind"], "left").select("job_id", F.coalesce(c("first") < c("job_id"), F.lit(False)).alias("active"))


@query(sql("SELECT count(DISTINCT product_id) AS products, count(DISTINCT CASE WHEN image_url IS NOT NULL THEN product_id END) AS pictured FROM candidates", "candidates"))
def distinct_pictured(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "candidates").agg(F.count_distinct("product_id").alias("products"), F.count_distinct(F.when(c("image_url").isNotNull(), c("product_id"))).alias("pictured"))


@query(
    sql(
        """SELECT relationship AS source, count(*) AS total, count(*) FILTER (WHERE logo_visible) AS with_ai, count(*) FILTER (WHERE NOT logo_visible) AS without_ai, count(*) FILTER (WHERE visible_text IS NOT NULL) AS with_browser,
  round(count(*) FILTER (WHERE logo_visible) / count(*), 2) AS ai_ratio, round(avg(confidence), 2) AS mean_confidence, round(coalesce(sum(area), 0), 6) AS cost FROM items GROUP BY relationship""",
        "items",
    )
)
def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    ai = F.count_if("logo_visible")
    return view(spark, d, "items").groupBy(c("relationship").alias("source")).agg(
        F.count("*").alias("total"), ai.alias("with_ai"), F.count_if(~c("logo_visible")).alias("without_ai"), F.count_if(c("visible_text").isNotNull()).alias("with_browser"),
        F.round(ai / F.count("*"), 2).alias("ai_ratio"), F.round(F.avg("confidence"), 2).alias("mean_confidence"), F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 6).alias("cost"),
    )


@query(sql("SELECT kind AS model, count(*) AS entries, sum(media_id)::BIGINT AS hits, round(sum(cost), 4) AS cost, round(sum(media_id * cost), 3) AS saved FROM jobs GROUP BY kind", "jobs"))
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "jobs").groupBy(c("kind").alias("model")).agg(F.count("*").alias("entries"), F.sum("media_id").alias("hits"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sum(c("media_id") * c("cost")), 3).alias("saved"))


@query("SELECT CASE WHEN embedding IS NULL THEN 'pending' ELSE 'ready' END AS status, len(embedding)::INTEGER AS dimension, count(*) AS n FROM embeddings GROUP BY 1, 2")
def embedding_status(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.groupBy(F.when(c("embedding").isNull(), "pending").otherwise("ready").alias("status"), F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))


@query(sql("SELECT owner_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'queued') AS queued FROM jobs GROUP BY owner_id", "jobs"))
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "jobs").groupBy("owner_id").agg(F.count("*").alias("jobs"), *[F.count_if(c("status") == s).alias(s) for s in ("completed", "running", "queued")])


@query(
    sql(
        """+ u AS (SELECT query_id, CASE WHEN exact THEN 2 ELSE 1 END AS pass, count(*) AS detections, sum(CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END) AS calls, sum(CASE WHEN brand IS NULL THEN 1 ELSE 0 END) AS unresolved FROM candidates GROUP BY 1, 2)
SELECT query_id, max(detections) AS detections, sum(calls)::BIGINT AS calls, arg_max(unresolved, pass)::BIGINT AS unresolved FROM u GROUP BY query_id""",
        "candidates",
    )
)
def usage_merge(spark: SparkSession, d: str) -> DataFrame:
    """Usage of two passes in one: the most detections, the sum of calls, the later pass's unresolved."""
    one = view(spark, d, "candidates").groupBy("query_id", F.when(c("exact"), 2).otherwise(1).alias("pass")).agg(F.count("*").alias("detections"), F.count_if(c("price").isNotNull()).alias("calls"), F.count_if(c("brand").isNull()).alias("unresolved"))
    return one.groupBy("query_id").agg(F.max("detections").alias("detections"), F.sum("calls").alias("calls"), F.max_by("unresolved", "pass").alias("unresolved"))


@query(sql("+ t AS (SELECT query_id, lower(replace(source_type, 'visual', 'Hybrid ')) AS raw, score, source FROM candidates) SELECT raw, CASE trim(raw) WHEN 'hybrid' THEN 'catalog_and_external' END AS mode, count(*) AS n FROM t GROUP BY 1, 2", "candidates"))
def mode_aliases(spark: SparkSession, d: str) -> DataFrame:
    raw = F.lower(F.replace(c("source_type"), F.lit("visual"), F.lit("Hybrid ")))
    return view(spark, d, "candidates").select(raw.alias("raw")).groupBy("raw", routing.matching_mode(c("raw")).alias("mode")).agg(F.count("*").alias("n"))


@query(
    sql(
        """+ m AS (SELECT query_id, pos, CASE pos % 4 WHEN 0 THEN 'catalog_only' WHEN 1 THEN 'catalog_first' WHEN 2 THEN 'external_only' ELSE 'catalog_and_external' END AS mode, score > 0 AS enabled, price IS NOT NULL AS provider, exact AS matched, brand IS NOT NULL AS forced, store IS NULL AS fallback FROM candidates)
SELECT query_id, pos, CASE WHEN NOT enabled OR NOT provider OR mode = 'catalog_only' THEN false WHEN mode <> 'catalog_first' OR forced THEN true ELSE NOT matched AND fallback END AS call,
  CASE WHEN NOT enabled OR NOT provider OR mode = 'catalog_only' THEN 'disabled' WHEN mode <> 'catalog_first' OR forced THEN 'loading' WHEN matched OR NOT fallback THEN 'not_requested' ELSE 'loading' END AS status,
  enabled AND provider AND mode = 'catalog_first' AND NOT matched AND (forced OR fallback) AS is_fallback FROM m""",
        "candidates",
    )
)
def source_routing(spark: SparkSession, d: str) -> DataFrame:
    mode = F.array(*map(F.lit, ["catalog_only", "catalog_first", "external_only", "catalog_and_external"]))[(c("pos") % 4).cast("int")]
    call = routing.external_call(mode, c("score") > 0, c("price").isNotNull(), c("exact"), c("brand").isNotNull(), c("store").isNull())
    return view(spark, d, "candidates").select("query_id", "pos", call.alias("r")).select("query_id", "pos", "r.*")


@query(
    sql(
        """+ m AS (SELECT *, CASE WHEN pos = 1 THEN 'exact_hash' WHEN pos = 2 THEN 'embedding' END AS stage FROM candidates)
SELECT query_id, pos, CASE WHEN NOT (store IS NULL AND score >= 60) THEN 'similar' WHEN source = 'catalog' AND coalesce(stage = 'exact_hash', false) OR source = 'external' AND coalesce(match_type = 'exact', false) THEN 'exact' ELSE 'probable' END AS match_type,
  CASE WHEN exact THEN 'similar' WHEN score / 180 >= CASE WHEN source = 'catalog' THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END THEN 'exact' ELSE 'probable' END AS by_source FROM m""",
        "candidates",
    )
)
def match_types(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(c("pos") == 1, "exact_hash").when(c("pos") == 2, "embedding")
    shown = routing.candidate_match_type(c("source"), stage, c("match_type"), c("score"), F.lit(60.0), c("store").isNull())
    return view(spark, d, "candidates").select("query_id", "pos", shown.alias("match_type"), routing.classify_by_source(F.when(c("exact"), "SIMILAR").otherwise("MATCH"), c("score") / 180, c("source")).alias("by_source"))


_BLOCK = "CASE {0} % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'timeout' WHEN 2 THEN 'error' WHEN 3 THEN 'unresolved' END"


@query(
    sql(
        f"""+ b AS (SELECT query_id, pos, {_BLOCK.format('product_id')} AS k, {_BLOCK.format('(product_id // 5)')} AS e FROM candidates),
s AS (SELECT query_id, pos, CASE WHEN k IS NULL OR e IS NULL THEN 'matching_error' WHEN k = 'matched' THEN 'catalog_matched' WHEN e = 'matched' THEN 'external_candidate' WHEN k = 'timeout' THEN 'catalog_timeout' WHEN e = 'timeout' THEN 'external_timeout'
  WHEN k = 'error' THEN CASE WHEN e = 'unresolved' THEN 'partial_result' ELSE 'matching_error' END WHEN e = 'error' THEN 'partial_result' ELSE 'no_match' END AS status FROM b)
SELECT query_id, pos, status, status IN ('catalog_timeout', 'external_timeout', 'matching_error') AS retryable, CASE status WHEN 'catalog_matched' THEN 'catalog_matched' WHEN 'external_candidate' THEN 'review_required' ELSE 'detected' END AS item_status FROM s""",
        "candidates",
    )
)
def product_statuses(spark: SparkSession, d: str) -> DataFrame:
    """A product's state from two blocks, whether to try again, and the item's state that follows."""
    block = lambda n: F.get(F.array(*map(F.lit, ["matched", "timeout", "error", "unresolved"])), (n % 5).cast("int"))
    rows = view(spark, d, "candidates").select("query_id", "pos", routing.product_status(block(c("product_id")), block(F.floor(c("product_id") / 5))).alias("status"))
    return rows.select("query_id", "pos", "status", c("status").isin(routing.RETRYABLE).alias("retryable"), routing.item_status(c("status")).alias("item_status"))


@query(sql("SELECT job_id, item_no, CASE lower(category) WHEN 'ropa' THEN 0.7 WHEN 'electronics' THEN 0.9 ELSE 0.82 END::DOUBLE AS threshold, confidence >= CASE lower(category) WHEN 'ropa' THEN 0.7 WHEN 'electronics' THEN 0.9 ELSE 0.82 END::DOUBLE AS reached FROM items", "items"))
def category_thresholds(spark: SparkSession, d: str) -> DataFrame:
    threshold = routing.category_threshold(c("category"), {"ropa": 0.7, "electronics": 0.9}, 0.82)
    return view(spark, d, "items").select("job_id", "item_no", threshold.alias("threshold"), (c("confidence") >= threshold).alias("reached"))


@query(
    sql(
        """SELECT query_id, pos, CASE WHEN match_type IS NOT NULL THEN match_type WHEN exact THEN 'near_exact' WHEN score / 150 >= 0.8 THEN 'near_exact' ELSE 'similar' END AS match_type,
  CASE WHEN image_url IS NULL THEN 'none' WHEN source = 'catalog' THEN 'synced' ELSE 'pending_database_sync' END AS image_status FROM candidates""",
        "candidates",
    )
)
def legacy_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of old recommendations from their reason, and where their image lives."""
    reason = F.when(c("exact"), F.concat(F.lit("near_exact match ("), c("score").cast("string"), F.lit(" pts)")))
    kind = routing.recommendation_type(c("match_type"), reason, c("score") / 150)
    return view(spark, d, "candidates").select("query_id", "pos", kind.alias("match_type"), routing.image_status(c("image_url"), F.when(c("source") == "catalog", "postgres").otherwise("file")).alias("image_status"))


@query(sql("SELECT query_id, pos, provider, ((store IS NOT NULL)::INT + (price IS NOT NULL)::INT + starts_with(link, 'http')::INT + 1) / 4 AS commercial_score, score / 180 AS final_score FROM candidates WHERE source = 'external' AND score / 180 >= 0.6 AND image_url IS NOT NULL AND provider IN ('serpapi_google_lens', 'dataforseo_google_shopping')", "candidates"))
def external_capture(spark: SparkSession, d: str) -> DataFrame:
    """Outside matches that are kept for review, with their commercial score."""
    rows = view(spark, d, "candidates").where(routing.capturable(F.lit("EXTERNAL_MATCH"), c("source"), c("score") / 180, c("image_url"), c("link"), c("provider")))
    return rows.select("query_id", "pos", "provider", routing.commercial_signals(c("store"), c("price"), c("link"), c("image_url")).alias("commercial_score"), (c("score") / 180).alias("final_score"))


@query(
    sql(
        """+ p AS (SELECT query_id, max(pos) < 7 AS allowed, bool_or(product_id % 50 = 0) AS failed, bool_or(exact AND score > 100) AS matched, count(*) FILTER (WHERE score > 60) AS similar_n, sum(price) AS usd FROM candidates GROUP BY query_id)
SELECT query_id, CASE WHEN NOT allowed THEN 'budget_exhausted' WHEN failed THEN 'provider_error' WHEN matched THEN 'matched' WHEN similar_n > 0 THEN 'similar_only' ELSE 'no_match' END AS status, round(coalesce(usd, 0) * 0.92::DOUBLE, 4) AS cost_eur FROM p""",
        "candidates",
    )
)
def pipeline_statuses(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "candidates").groupBy("query_id").agg((F.max("pos") < 7).alias("allowed"), F.bool_or(c("product_id") % 50 == 0).alias("failed"), F.bool_or(c("exact") & (c("score") > 100)).alias("matched"), F.count_if(c("score") > 60).alias("similar"), F.sum("price").alias("usd"))
    status = routing.pipeline_status(c("allowed"), c("failed"), c("matched"), c("similar"))
    return rows.select("query_id", status.alias("status"), F.round(F.coalesce("usd", F.lit(0.0)) * routing.USD_TO_EUR, 4).alias("cost_eur"))


_STATE = """CASE WHEN paused OR NOT enabled THEN 'paused' WHEN agreement OR lifecycle = 'partner_required' THEN 'partner_required' WHEN health = 'disallowed' THEN 'blocked_by_robots' WHEN health = 'blocked' THEN 'blocked_or_challenged'
  WHEN implementation = 'scaffold' OR lifecycle = 'pending' THEN 'pending' WHEN health = 'error' THEN 'error' WHEN live THEN 'implemented_verified' ELSE 'implemented_unverified' END"""


@query(sql(f"SELECT connector_id, {_STATE} AS status, enabled AND implementation <> 'scaffold' AND lifecycle NOT IN ('pending', 'partner_required') AND NOT agreement AND credentials AS can_sync FROM connectors", "connectors"))
def connector_statuses(spark: SparkSession, d: str) -> DataFrame:
    status = routing.connector_status(c("paused"), c("enabled"), c("agreement"), c("lifecycle"), c("health"), c("implementation"), c("live"))
    return view(spark, d, "connectors").select("connector_id", status.alias("status"), routing.can_sync(c("enabled"), c("implementation"), c("lifecycle"), c("agreement"), c("credentials")).alias("can_sync"))


@query(sql(f"+ s AS (SELECT lifecycle, {_STATE} AS status FROM connectors) SELECT lifecycle, status, count(*) AS n FROM s GROUP BY GROUPING SETS ((lifecycle), (status))", "connectors"))
def registry_tallies(spark: SparkSession, d: str) -> DataFrame:
    status = routing.connector_status(c("paused"), c("enabled"), c("agreement"), c("lifecycle"), c("health"), c("implementation"), c("live"))
    rows = view(spark, d, "connectors").select("lifecycle", status.alias("status"))
    return rows.groupingSets([["lifecycle"], ["status"]], "lifecycle", "status").agg(F.count("*").alias("n"))


@query(
    sql(
        """+ k AS (SELECT job_id, item_no, visible_brand AS vb, CASE WHEN item_no % 3 = 0 THEN 'unknown' WHEN item_no % 3 = 1 THEN brand END AS guess, pattern, logo_visible AS logo, relevance IS NOT NULL AS present,
    CASE WHEN confidence > 0.6 THEN 'Crop ' || brand END AS cb, CASE WHEN confidence > 0.8 THEN 'verified' WHEN confidence > 0.3 THEN 'probable' ELSE 'unknown' END AS cs, CASE WHEN area > 0.5 THEN 'dots' END AS cp, area > 0.3 AS cl FROM items),
n AS (SELECT *, CASE WHEN vb IS NOT NULL AND cs <> 'verified' THEN vb ELSE coalesce(cb, vb) END AS nb, CASE WHEN guess <> 'unknown' THEN guess END AS ng FROM k)
SELECT job_id, item_no, CASE WHEN present THEN nb ELSE vb END AS visible_brand, CASE WHEN present THEN ng ELSE guess END AS brand_guess, CASE WHEN present THEN coalesce(cp, pattern) ELSE pattern END AS pattern, CASE WHEN present THEN cl OR logo ELSE logo END AS logo_visible,
  CASE WHEN present THEN CASE WHEN nb IS NOT NULL AND (cs = 'verified' OR vb IS NOT NULL) THEN 'verified' WHEN nb IS NOT NULL THEN cs WHEN guess IS NOT NULL THEN 'probable' ELSE 'unknown' END END AS brand_status FROM n""",
        "items",
    )
)
def enrichment_merge(spark: SparkSession, d: str) -> DataFrame:
    """Items after a closer look at their crop."""
    none = F.array().cast("array<string>")
    guess = F.when(c("item_no") % 3 == 0, "unknown").when(c("item_no") % 3 == 1, c("brand"))
    item = {"visible_brand": c("visible_brand"), "brand_guess": guess, "color": F.lit(None).cast("string"), "pattern": c("pattern"), "logo_visible": c("logo_visible"), "features": none}
    state = F.when(c("confidence") > 0.8, "verified").when(c("confidence") > 0.3, "probable").otherwise("unknown")
    crop = {"visible_brand": F.when(c("confidence") > 0.6, F.concat(F.lit("Crop "), "brand")), "brand_guess": F.lit(None).cast("string"), "brand_status": state, "color": F.lit(None).cast("string"), "pattern": F.when(c("area") > 0.5, "dots"), "logo_visible": c("area") > 0.3, "features": none, "terms": none}
    merged = routing.enriched(item, crop, c("relevance").isNotNull())
    return view(spark, d, "items").select("job_id", "item_no", *[merged[n].alias(n) for n in ("visible_brand", "brand_guess", "pattern", "logo_visible", "brand_status")])


@query(sql("SELECT query_id, pos, price, CASE WHEN score * 1000 > price THEN score * 1000 END AS original_price FROM candidates", "candidates"))
def discount_rule(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "candidates").select("query_id", "pos", "price", routing.real_discount(c("score") * 1000, c("price")).alias("original_price"))


@query(sql(f"SELECT frame_id, count(*) AS items, count(*) FILTER (WHERE {_PREMIUM}) AS premium FROM items GROUP BY frame_id", "items"))
def premium_items(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "items").groupBy("frame_id").agg(F.count("*").alias("items"), F.count_if(_premium()).alias("premium"))
