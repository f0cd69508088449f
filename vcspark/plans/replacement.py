"""Outputs replaced behind one pointer, copies with their comparison, layers merged with evidence, logs tailed, pages read by offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.operators import extraction
from vcspark.plans.entities import sql, view
from vcspark.plans.registry import query, table
from vcspark.sources import commits, copies, paged
from vcspark.sources.shared import new_shared_path
from vcspark.streaming import tail

_STORED = "job_id, status, job_id % 2 AS revision"
_FINISHED = "job_id, job_id % 3 AS revision"


@query(
    sql(
        f"""+ stored AS (SELECT {_STORED} FROM jobs), ok AS (SELECT s.* FROM stored s JOIN (SELECT {_FINISHED} FROM jobs WHERE status = 'running') f USING (job_id, revision)),
after AS (SELECT job_id, 'completed' AS status, revision + 1 AS revision FROM ok UNION ALL SELECT * FROM stored WHERE job_id NOT IN (SELECT job_id FROM ok)),
i AS (SELECT job_id, item_no FROM items WHERE job_id NOT IN (SELECT job_id FROM ok) UNION ALL SELECT job_id, item_no + 10 FROM items WHERE item_no < 4 AND job_id IN (SELECT job_id FROM ok)),
c AS (SELECT query_id AS job_id, pos FROM candidates WHERE query_id NOT IN (SELECT job_id FROM ok) UNION ALL SELECT query_id, pos FROM candidates WHERE score > 60 AND query_id IN (SELECT job_id FROM ok))
SELECT job_id, status, revision::BIGINT AS revision, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sum, 0)::BIGINT AS items_sum, coalesce(n_candidates, 0)::BIGINT AS n_candidates
FROM after LEFT JOIN (SELECT job_id, count(*) AS n_items, sum(item_no) AS items_sum FROM i GROUP BY job_id) USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS n_candidates FROM c GROUP BY job_id) USING (job_id)""",
        "items",
        "jobs",
        "candidates",
    )
)
def job_outputs_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Running jobs finish: their items, candidates and status change in one commit, unless their revision moved on; read through the pointer."""
    root = new_shared_path(spark, "job-outputs")
    jobs = view(spark, d, "jobs")
    items, candidates = view(spark, d, "items").select("job_id", "item_no"), view(spark, d, "candidates").select(F.col("query_id").alias("job_id"), "pos", "score")
    first = commits.create_set(spark, root, {"jobs": jobs.selectExpr(*_STORED.split(", ")), "items": items, "candidates": candidates}, "job_id", buckets=16)
    finished = jobs.where("status = 'running'").selectExpr(*_FINISHED.split(", "))
    made = {"items": items.where("item_no < 4").withColumn("item_no", F.col("item_no") + 10), "candidates": candidates.where("score > 60")}
    last, _ = commits.finish_jobs(spark, root, "jobs", made, finished, {"status": F.lit("completed")}, first)
    read = lambda name: commits.read_committed(spark, root, name, last)
    i = read("items").groupBy("job_id").agg(F.count("*").alias("n_items"), F.sum("item_no").alias("items_sum"))
    c = read("candidates").groupBy("job_id").agg(F.count("*").alias("n_candidates"))
    return read("jobs").join(i, "job_id", "left").join(c, "job_id", "left").fillna(0, ["n_items", "items_sum", "n_candidates"])


def _copied(name: str, vector: str | None = None) -> str:
    whole = f"SELECT '{name}' AS table_name, NULL::VARCHAR AS column_name, count(*) AS source_n, count(*) AS target_n, NULL::BIGINT AS source_least, NULL::BIGINT AS target_least, NULL::BIGINT AS source_most, NULL::BIGINT AS target_most, true AS same FROM {name}"
    return whole if vector is None else f"{whole} UNION ALL SELECT '{name}', '{vector}', count({vector}), count({vector}), min(len({vector})), min(len({vector})), max(len({vector})), max(len({vector})), true FROM {name}"


@query(" UNION ALL ".join([_copied("documents"), _copied("embeddings", "embedding"), _copied("lineitem"), _copied("conversations")]))
def copied_tables(spark: SparkSession, d: str) -> DataFrame:
    """Four tables copied into a new place, rows and vector lengths compared on both sides."""
    names = ["documents", "embeddings", "lineitem", "conversations"]
    return copies.copy_tables(spark, {n: table(spark, d, n) for n in names}, new_shared_path(spark, "copies"), {"embeddings": ["embedding"]})


# What the layers say of an order: (layer, field, value, whether it says it), for both engines.
_SAYS = [
    ("feed", "price", "cast(l_extendedprice AS {text})", "l_linenumber = 1 AND l_tax > 0.04"),
    ("json_ld", "price", "cast(l_extendedprice AS {text})", "l_linenumber = 2"),
    ("json_ld", "title", "'Item ' || l_partkey", "l_linenumber = 2 AND l_discount > 0.03"),
    ("microdata", "title", "'Thing ' || l_partkey", "l_linenumber = 3"),
    ("open_graph", "title", "CASE WHEN l_tax > 0.02 THEN 'Shop ' || l_suppkey ELSE '  ' END", "l_linenumber = 1"),
    ("open_graph", "image", "'https://img.example.com/' || l_partkey", "l_linenumber = 4"),
    ("dom", "currency", "'EUR'", "l_returnflag = 'N'"),
    ("url", "category", "l_returnflag", "l_linestatus = 'F'"),
    ("model", "brand", "'Brand ' || (l_suppkey % 5)", "l_quantity > 30"),
    ("model", "color", "CASE WHEN l_quantity > 20 THEN l_linestatus END", "l_linenumber = 2"),
    ("other", "sku", "'k' || l_partkey", "l_linenumber = 1"),
]
_FIELDS = sorted({says[1] for says in _SAYS})
_ROWS = " UNION ALL ".join(f"SELECT l_orderkey, '{layer}' AS layer, '{field}' AS field, {value} AS value FROM {{lineitem}} WHERE {when}" for layer, field, value, when in _SAYS)
_PLACE = "CASE layer " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(extraction.LAYERS)) + f" ELSE {len(extraction.LAYERS)} END"
_TRUST = "CASE layer " + " ".join(f"WHEN '{x}' THEN {t}" for x, t in extraction.TRUST.items()) + " ELSE 0 END"
_SCORED = ", ".join(f"'{f}'" for f in [*extraction.ESSENTIAL, *extraction.DESIRABLE])


@query(
    f"""
WITH r AS ({_ROWS.format(lineitem="lineitem", text="VARCHAR")}),
w AS (SELECT *, {_PLACE} AS place, {_TRUST}::DECIMAL(4, 2) AS trust FROM r WHERE trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY l_orderkey, field ORDER BY {_PLACE}, layer, value) = 1)
SELECT l_orderkey, {", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in _FIELDS)}, string_agg(field || '=' || layer, ' ' ORDER BY place, layer, field) AS evidence,
floor(coalesce(sum(CASE WHEN field IN ({_SCORED}) THEN trust END), 0)::DOUBLE / 9 * 100 + 0.5) / 100 AS confidence FROM w GROUP BY l_orderkey"""
)
def merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Layers of each order merged: the fields, where each comes from, and the confidence over the nine that count."""
    says = spark.sql(_ROWS.replace("{text}", "string"), lineitem=table(spark, d, "lineitem"))
    merged = extraction.merge_layers(says, ["l_orderkey"])
    source = F.array_join(F.transform("evidence", lambda e: F.concat(e.field, F.lit("="), e.layer)), " ").alias("evidence")
    return merged.select("l_orderkey", *[F.try_element_at("fields", F.lit(f)).alias(f) for f in _FIELDS], source, "confidence")


@query()
def page_products(spark: SparkSession, d: str) -> DataFrame:
    """Each page's product: its layers merged, with evidence, confidence and whether stronger means are called for."""
    merged = extraction.merge_layers(extraction.page_layers(table(spark, d, "pages")), ["page_id", "url"])
    return merged.withColumn("escalate", extraction.needs_escalation(F.map_keys("fields")))


_ENTRY = "user_id AS job_id, event_id AS seq, event_type AS body"


@query("SELECT user_id AS job_id, event_id AS seq, event_type AS body, event_id > (SELECT max(event_id) FROM events) * 0.6 AS live FROM events WHERE event_id > 50 AND event_id % 5 <= 2")
def tailed_logs(spark: SparkSession, d: str) -> DataFrame:
    """A tail over the log: what is stored of each job, then the stream beyond it."""
    events = table(spark, d, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    path = new_shared_path(spark, "tail")
    entries = events.where("event_id % 5 <= 2").selectExpr(*_ENTRY.split(", "))
    entries.write.parquet(f"{path}/log")
    anchors = tail.open_tail(entries.where(F.col("seq") <= last * 0.6), path, after=50, limit=None)
    live = spark.readStream.schema(entries.schema).parquet(f"{path}/log")
    tail.follow(live, anchors, path, after=50, availableNow=True).awaitTermination()
    return tail.read_tail(spark, path, entries)


@query()
def log_flushes(spark: SparkSession, d: str) -> DataFrame:
    """The log's entries by type as jobs, with the flush that carries each."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 + F.col("user_id") % 5).cast("long").alias("at_ms"), F.col("props").alias("body"))
    return tail.flushes(rows).drop("body")


@query("SELECT p_partkey, trim(p_name) AS p_name, p_size, p_retailprice FROM part")
def paged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Products written as numbered pages of JSON and read back by offset."""
    spark.dataSource.register(paged.PagedRows)
    folder = new_shared_path(spark, "pages-by-offset")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    paged.write_pages(part, "p_partkey", 0, folder)
    return spark.read.format("paged_rows").schema(part.schema).load(folder)
