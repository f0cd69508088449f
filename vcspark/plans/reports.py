"""Counts, shares and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vcspark.functions.text import url_domain
from vcspark.operators import reports, timeline
from vcspark.plans.registry import query, table


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS large, count(DISTINCT user_id) AS users, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 2) AS error_rate FROM events")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type") == "error"
    return table(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(e).alias("errors"), F.count_if(F.col("value") > 50).alias("large"), F.countDistinct("user_id").alias("users"), F.round(100.0 * F.count_if(e) / F.count("*"), 2).alias("error_rate"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def group_counts_sets(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("__lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM __lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")


@query(
    """
SELECT event_type AS model, (user_id % 10)::VARCHAR AS connector, grouping(event_type)::INT AS g_model, grouping(user_id % 10)::INT AS g_connector, count(*) AS calls, round(sum(value), 2) AS cost
FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY GROUPING SETS ((), (event_type), (user_id % 10))
"""
)
def usage_summary_sets(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where("ts >= timestamp'2024-01-10'").withColumn("connector", (F.col("user_id") % 10).cast("string")).withColumnRenamed("event_type", "model")
    return reports.usage_summary(events, ["model", "connector"], "value")


@query(
    """
WITH g AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS products, round(sum(chars) / sum(n), 2) AS mean_chars, string_agg(lang || ':' || n, ',' ORDER BY lang) AS by_extractor FROM g GROUP BY source
"""
)
def extractor_histogram(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", "lang", F.col("n").cast("string"))))
    return g.groupBy("source").agg(F.sum("n").alias("products"), F.round(F.sum("chars") / F.sum("n"), 2).alias("mean_chars"), F.array_join(pairs, ",").alias("by_extractor"))


@query(
    """
WITH b AS (SELECT regexp_extract(p_name, '^([a-z]+) ', 1) AS brand FROM part)
SELECT brand, count(*) AS n FROM b WHERE length(brand) BETWEEN 2 AND 28 GROUP BY brand HAVING count(*) >= 4
"""
)
def having_frequency(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").select(F.regexp_extract("p_name", "^([a-z]+) ", 1).alias("brand")).where(F.length("brand").between(2, 28))
    return b.groupBy("brand").agg(F.count("*").alias("n")).where("n >= 4")


@query("SELECT l_orderkey, l_linenumber AS best_line, l_extendedprice AS best_price FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber) = 1")
def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(F.desc_nulls_last("l_extendedprice"), "l_linenumber")
    li = table(spark, d, "lineitem")
    return li.withColumn("n", F.row_number().over(order)).where("n = 1").select("l_orderkey", F.col("l_linenumber").alias("best_line"), F.col("l_extendedprice").alias("best_price"))


@query("SELECT o_orderkey, (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS best FROM orders")
def scalar_subquery_best(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"))
    return table(spark, d, "orders").join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "best")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount >= 0.1)")
def semi_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_discount >= 0.1"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("SELECT p_type AS category, count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) GROUP BY p_type ORDER BY n DESC, category LIMIT 10")
def top_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """The ten categories with most products that nothing matched (a top-k report)."""
    rest = table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    return rest.groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase', 'signup')")
def levels_at_least(spark: SparkSession, d: str) -> DataFrame:
    """Log rows of a level and above."""
    return table(spark, d, "events").where(reports.level_at_least(F.col("event_type"), ["click", "view", "signup", "purchase", "error"], "signup")).select("event_id", "event_type")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    return reports.retained(table(spark, d, "events"), "ts", "2024-01-31", 10).select("event_id", "ts")


@query("SELECT user_id, event_type, count(*) AS n, round(count(*) / 60.0, 4) AS per_minute FROM events WHERE ts > TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL")
def throughput_window(spark: SparkSession, d: str) -> DataFrame:
    return reports.trailing_throughput(table(spark, d, "events"), "ts", "2024-01-15 12:00:00", 60, ["user_id", "event_type"])


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_log_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query(
    """
WITH o AS (SELECT o_orderpriority AS mode, o_totalprice AS ms, o_orderstatus AS s FROM orders)
SELECT mode, count(*) AS n, round(100.0 * count(*) FILTER (WHERE s = 'F') / count(*), 2) AS resolution_rate, round(avg(ms) FILTER (WHERE s <> 'P'), 4) AS mean_ms,
  round(sum(ms) FILTER (WHERE s = 'F'), 2) AS incurred, round(sum(ms) FILTER (WHERE s = 'O'), 2) AS avoided FROM o GROUP BY mode
"""
)
def matching_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("mode"), F.col("o_totalprice").alias("ms"), F.col("o_orderstatus").alias("s"))
    when = lambda s: F.when(F.col("s") == s, F.col("ms"))
    return o.groupBy("mode").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("s") == "F") / F.count("*"), 2).alias("resolution_rate"), F.round(F.avg(F.when(F.col("s") != "P", F.col("ms"))), 4).alias("mean_ms"), F.round(F.sum(when("F")), 2).alias("incurred"), F.round(F.sum(when("O")), 2).alias("avoided"))


@query(
    """
SELECT event_type, list_sort(list(value))[(floor(count(*) * 0.5))::INT + 1] AS p50, list_sort(list(value))[(floor(count(*) * 0.95))::INT + 1] AS p95, round(avg(value), 4) AS mean FROM events GROUP BY event_type
"""
)
def timing_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return reports.index_percentiles(table(spark, d, "events"), ["event_type"], "value", "event_id", {"p50": 0.5, "p95": 0.95})


@query(
    """
WITH m AS (SELECT * FROM (VALUES ('Brand#', 1.0), ('Brand#1', 2.0), ('Brand#2', 3.0), ('Brand#23', 4.0)) t(prefix, rate))
SELECT p_partkey, max_by(rate, length(prefix))::DOUBLE AS rate, round(p_size * max_by(rate, length(prefix)) / 1000000, 6)::DOUBLE AS cost FROM part JOIN m ON starts_with(p_brand, prefix) GROUP BY p_partkey, p_size
"""
)
def model_cost(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("Brand#", 1.0), ("Brand#1", 2.0), ("Brand#2", 3.0), ("Brand#23", 4.0)], "prefix string, rate double")
    priced = reports.longest_prefix_rate(table(spark, d, "part"), "p_brand", rates)
    return priced.select("p_partkey", "rate", F.round(F.col("p_size") * F.col("rate") / 1_000_000, 6).alias("cost"))


@query(
    """
WITH r AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events)
SELECT user_id, event_id, round(spent, 2) AS spent, spent <= 500 AS within FROM r
"""
)
def budget_running(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").withColumn("s", F.sum("value").over(order)).select("user_id", "event_id", F.round("s", 2).alias("spent"), (F.col("s") <= 500).alias("within"))


@query(
    r"""
SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS domain,
  regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[0-9]+', 'N', 'g'), '/+$', '') AS shape,
  count(*) AS n, min(length(url))::INTEGER AS shortest, max(length(url))::INTEGER AS longest FROM pages GROUP BY ALL
"""
)
def url_shapes(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    shape = F.regexp_replace(F.regexp_replace(path, "[0-9]+", "N"), "/+$", "")
    return table(spark, d, "pages").groupBy(url_domain("url").alias("domain"), shape.alias("shape")).agg(F.count("*").alias("n"), F.min(F.length("url")).alias("shortest"), F.max(F.length("url")).alias("longest"))


@query("SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem GROUP BY l_partkey")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("suppliers"))


@query(
    """
SELECT s.s_suppkey, s.s_name, coalesce(c.n, 0) AS sightings, coalesce(c.total, 0)::DOUBLE AS total, n.n_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
LEFT JOIN (SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON c.l_suppkey = s.s_suppkey
"""
)
def source_overview(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("sightings"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(seen, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select("s_suppkey", "s_name", F.coalesce("sightings", F.lit(0)).alias("sightings"), F.coalesce("total", F.lit(0.0)).alias("total"), "n_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'error' WHEN c_mktsegment = 'BUILDING' THEN 'skipped' WHEN c_acctbal > 5000 THEN 'created' ELSE 'unchanged' END AS outcome FROM customer")
def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("c_acctbal") < 0, "error").when(F.col("c_mktsegment") == "BUILDING", "skipped").when(F.col("c_acctbal") > 5000, "created").otherwise("unchanged")
    return table(spark, d, "customer").select("c_custkey", outcome.alias("outcome"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice AS price, previous_price FROM (SELECT *, lag(l_extendedprice) OVER w AS previous_price, row_number() OVER w AS n FROM (SELECT DISTINCT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem) WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber, l_extendedprice)) WHERE n > 1 AND l_extendedprice IS DISTINCT FROM previous_price")
def price_changes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").distinct().withColumn("tie", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), "l_extendedprice"))
    changed = timeline.price_changes(li.withColumnRenamed("l_extendedprice", "price"), ["l_partkey"], "l_shipdate", "price", "tie")
    return changed.select("l_partkey", "l_orderkey", "l_linenumber", "price", "previous_price")
