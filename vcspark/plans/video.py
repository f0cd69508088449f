"""Video queries: ``events`` stand for frames and appearances, ``user_id`` for the video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.functions import geometry
from vcspark.functions.text import time_bucket
from vcspark.operators import timeline, tracking
from vcspark.plans.registry import query, table

_HOURS = "round(epoch(ts) / 3600.0, 6)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """events with ``at``, hours since 1970, rounded so that both engines agree."""
    return table(spark, d, "events").withColumn("at", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0, 6))


@query(
    f"""
WITH e AS (SELECT user_id, {_HOURS} AS t0 FROM events),
f AS (SELECT *, CASE WHEN t0 - lag(t0) OVER (PARTITION BY user_id ORDER BY t0) <= 6 THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS segment FROM f)
SELECT user_id, segment::BIGINT AS segment, min(t0) AS start, max(t0) AS "end", count(*) AS n FROM g GROUP BY user_id, segment
"""
)
def segments_gaps(spark: SparkSession, d: str) -> DataFrame:
    return timeline.segments(_frames(spark, d), ["user_id"], "at", gap=6.0)


@query("SELECT event_id, greatest(0, floor((value - 5) / 5) * 5)::BIGINT AS bucket FROM events")
def time_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", time_bucket(F.col("value") - 5).alias("bucket"))


_SCENES = """
WITH s AS (SELECT user_id AS job_id, event_id % 500 / 10.0 AS start_seconds, event_id % 500 / 10.0 + value / 100 AS end_seconds, CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS frames FROM events),
ms AS (SELECT job_id, floor(start_seconds * 1000 + 0.5)::BIGINT AS s, floor(end_seconds * 1000 + 0.5)::BIGINT AS e, start_seconds AS o, frames FROM s),
w AS (SELECT *, lag(e) OVER k AS before, lead(s) OVER k IS NULL AS last FROM ms WINDOW k AS (PARTITION BY job_id ORDER BY o, e)),
u AS (SELECT DISTINCT user_id AS job_id FROM events),
r AS (
  SELECT job_id, 0::BIGINT AS start_ms, s AS end_ms, 'before_first_scene' AS reason FROM w WHERE before IS NULL AND s > 0
  UNION ALL SELECT job_id, before, s, 'gap_between_scenes' FROM w WHERE s > before
  UNION ALL SELECT job_id, e, 60000, 'after_last_scene' FROM w WHERE last AND e < 60000
  UNION ALL SELECT job_id, s, e, 'scene_zero_frames' FROM w WHERE frames = 0
  UNION ALL SELECT job_id, 0, 60000, 'before_first_scene' FROM u WHERE job_id NOT IN (SELECT job_id FROM s)
)
"""


def _scenes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    start = F.col("event_id") % 500 / 10.0
    scenes = events.select(F.col("user_id").alias("job_id"), start.alias("start_seconds"), (start + F.col("value") / 100).alias("end_seconds"), F.when(F.col("event_type") == "error", 0).otherwise(2).alias("analyzed_frame_count"))
    return scenes, events.select(F.col("user_id").alias("job_id")).distinct().withColumn("duration_ms", F.lit(60000).cast("long"))


@query(_SCENES + "SELECT * FROM r")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return timeline.uncovered_ranges(*_scenes(spark, d))


@query(
    _SCENES
    + """, c AS (SELECT job_id, sum(greatest(0, end_ms - start_ms))::BIGINT AS missing FROM r GROUP BY job_id), n AS (SELECT job_id, count(*) AS scene_count FROM s GROUP BY job_id)
SELECT u.job_id, 60000::BIGINT AS duration_ms, greatest(0, 60000 - coalesce(missing, 0))::BIGINT AS covered_ms, floor(greatest(0, 60000 - coalesce(missing, 0)) / 60000 * 1000 + 0.5) / 10 AS coverage_percent, coalesce(scene_count, 0) AS scene_count
FROM u LEFT JOIN c USING (job_id) LEFT JOIN n USING (job_id)
"""
)
def coverage_percent(spark: SparkSession, d: str) -> DataFrame:
    return timeline.coverage(*_scenes(spark, d))


@query(
    f"""
WITH e AS (SELECT user_id, event_type, {_HOURS} - 473352 AS t0 FROM events),
o AS (SELECT user_id, event_type, min(t0) AS first_seen, max(t0) AS last_seen, list(t0) AS times FROM e GROUP BY ALL),
i AS (SELECT DISTINCT user_id, user_id % 7 * 100.0 AS t FROM events)
SELECT o.user_id, event_type, t, len(list_filter(times, lambda x: abs(x - t) <= 6)) > 0 AS exact_appearance FROM i JOIN o ON o.user_id = i.user_id AND first_seen <= t + 6 AND last_seen >= t - 6
"""
)
def at_timestamp_range(spark: SparkSession, d: str) -> DataFrame:
    frames = _frames(spark, d).withColumn("at", F.col("at") - 473352)
    seen = frames.groupBy("user_id", "event_type").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.collect_list("at").alias("timestamps"))
    instants = frames.select("user_id", (F.col("user_id") % 7 * 100.0).alias("t")).distinct()
    return timeline.at_instants(seen, instants, "user_id", 6.0).select("user_id", "event_type", "t", "exact_appearance")


@query(
    """
WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS id, ts AS rt FROM events WHERE event_type = 'view'),
p AS (SELECT l.user_id, l.event_id, r.id, abs(epoch_us(r.rt) - epoch_us(l.ts)) AS gap, r.rt FROM l LEFT JOIN r ON l.user_id = r.user_id)
SELECT user_id, event_id, id AS nearest_id, gap AS distance FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, rt, id) = 1
"""
)
def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    left = events.where("event_type = 'purchase'").select("user_id", "event_id", "us")
    right = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), F.col("us").alias("at"))
    return timeline.nearest(left, right, "user_id", "us", "at", "id").select("user_id", "event_id", "nearest_id", "distance")


@query("SELECT user_id, event_type AS label FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, length(event_type) DESC, event_type) = 1")
def canonical_label(spark: SparkSession, d: str) -> DataFrame:
    return tracking.canonical_labels(table(spark, d, "events"), ["user_id"], "event_type").withColumnRenamed("event_type", "label")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Detections made of events: boxes by number, instants by second."""
    k = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), F.floor(k / 50).cast("double").alias("at"), k.alias("detection_id"), F.concat(F.lit("item "), F.col("event_type")).alias("name"), F.col("event_type").alias("category"),
        (k % 7 / 10.0).alias("x"), (k % 5 / 10.0).alias("y"), F.lit(0.3).alias("width"), (F.lit(0.2) + k % 3 / 10.0).alias("height"), F.round(F.col("value") / 100, 4).alias("confidence"),
    )


@query()
def tracker_assign(spark: SparkSession, d: str) -> DataFrame:
    return tracking.assign_tracks(_boxes(spark, d)).select("job_id", "detection_id", "track_id")


@query()
def nms_boxes(spark: SparkSession, d: str) -> DataFrame:
    return tracking.suppress_boxes(_boxes(spark, d), ["job_id", "at"]).select("job_id", "detection_id")


@query()
def identity_groups(spark: SparkSession, d: str) -> DataFrame:
    vec = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    none = F.lit(None)
    tracks = vec.select(
        F.floor(F.col("vec_id") / 25).alias("job_id"), F.col("vec_id").cast("string").alias("track_id"), (F.col("vec_id") % 60).cast("double").alias("first_seen"), (F.col("vec_id") % 60 + 2).cast("double").alias("last_seen"), none.cast("string").alias("slot"),
        F.lit("dress").alias("category"), F.lit("clothing").alias("family"), none.cast("int").alias("person_index"), F.when(F.col("vec_id") % 2 == 0, "red").otherwise("blue").alias("color"), F.col("embedding").cast("array<double>").alias("visual"), F.lit(60.0).alias("duration"),
    )
    return tracking.identity_groups(tracks)


@query(
    """
WITH b AS (SELECT event_id, event_id % 7 / 10.0 AS x, event_id % 5 / 10.0 AS y, 0.3 AS w, 0.2 + event_id % 3 / 10.0 AS h FROM events),
i AS (SELECT *, greatest(0, least(x + w, 0.7) - greatest(x, 0.2)) * greatest(0, least(y + h, 0.6) - greatest(y, 0.2)) AS inter FROM b)
SELECT event_id, round(CASE WHEN inter <= 0 THEN 0 ELSE inter / (w * h + 0.5 * 0.4 - inter) END, 6)::DOUBLE AS iou FROM i
"""
)
def box_iou(spark: SparkSession, d: str) -> DataFrame:
    fixed = geometry.box(*map(F.lit, (0.2, 0.2, 0.5, 0.4)))
    return _boxes(spark, d).select(F.col("detection_id").alias("event_id"), F.round(geometry.iou(geometry.box(*map(F.col, ("x", "y", "width", "height"))), fixed), 6).alias("iou"))


@query(
    """
WITH b AS (SELECT event_id, event_id % 7 / 10.0 AS x, event_id % 5 / 10.0 AS y, 0.3 AS w, 0.2 + event_id % 3 / 10.0 AS h, round(value / 100, 4) AS c, event_type FROM events),
s AS (SELECT *, least(1, least(w * 1280, h * 720) / 224) AS res, least(1, w * h / 0.35) AS vis,
  greatest(0, 1 - 0.3 * ((x <= 0.005)::INT + (y <= 0.005)::INT + (x + w >= 0.995)::INT + (y + h >= 0.995)::INT)) AS occ, least(0.95, w / h) / greatest(0.95, w / h) AS front FROM b)
SELECT event_id, round(0.2 * 0.5 + 0.15 * res + 0.2 * vis + 0.15 * occ + 0.1 * front + 0.1 * CASE WHEN event_type = 'view' THEN 1 ELSE 0.3 END + 0.1 * least(1, c), 4)::DOUBLE AS quality FROM s
"""
)
def crop_quality(spark: SparkSession, d: str) -> DataFrame:
    b: Column = geometry.box(*map(F.col, ("x", "y", "width", "height")))
    score = geometry.crop_quality(b, F.lit(0.5), F.lit("upper"), F.col("category") == "view", F.col("confidence"))["score"]
    return _boxes(spark, d).select(F.col("detection_id").alias("event_id"), F.round(score, 4).alias("quality"))


@query(
    """
WITH e AS (SELECT user_id AS job_id, event_id, value FROM events), b AS (SELECT job_id, arg_max(event_id, value * 1000000000 - event_id) AS best, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS appearances, count(DISTINCT floor(value / 10)) AS scenes FROM e GROUP BY job_id)
SELECT * FROM b
"""
)
def product_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per product: best crop, first and last sighting, number of appearances and scenes."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", "value")
    best = F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best")
    return e.groupBy("job_id").agg(best, F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.count("*").alias("appearances"), F.countDistinct(F.floor(F.col("value") / 10)).alias("scenes"))


@query(
    """
WITH j AS (SELECT DISTINCT user_id AS job_id, 40000 AS duration_ms FROM events), s AS (SELECT user_id AS job_id, event_id % 500 / 10.0 AS st, event_id % 500 / 10.0 + value / 100 - 0.1 AS en FROM events),
w AS (SELECT *, max(en) OVER (PARTITION BY job_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT job_id, 'scene_reversed' AS rule, count(*) AS n FROM w WHERE en < st GROUP BY job_id
UNION ALL SELECT job_id, 'scene_overlap', count(*) FROM w WHERE before > st GROUP BY job_id
UNION ALL SELECT job_id, 'scene_beyond_video', count(*) FROM w WHERE en * 1000 > 40001 GROUP BY job_id
UNION ALL SELECT user_id, 'product_outside_video', count(*) FROM events WHERE value * 1000 > 40001 GROUP BY user_id
UNION ALL SELECT user_id, 'product_without_tracks', count(*) FROM events WHERE event_type = 'error' GROUP BY user_id
"""
)
def integrity_rules(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumnRenamed("user_id", "job_id")
    start = F.col("event_id") % 500 / 10.0
    scenes = events.select("job_id", start.alias("start_seconds"), (start + F.col("value") / 100 - 0.1).alias("end_seconds"))
    products = events.select("job_id", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("track_count"), F.lit(0.0).alias("first_seen"), F.col("value").alias("last_seen"))
    return timeline.integrity_report(events.select("job_id", F.lit(40000).alias("duration_ms")).distinct(), scenes, products)


@query()
def stream_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Frames to analyse, decided by state carried from frame to frame; the batch form of the streaming operator."""
    from vcspark.streaming.sampling import sample_frames

    frames = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("frame_id"), F.substring(F.md5(F.floor(F.col("value") / 10).cast("string")), 1, 16).alias("hash"), (F.col("event_type") == "signup").alias("scene_changed"))
    return sample_frames(frames)


def video_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames made of events: uploads of 30 events by number, a scene change at a signup, up to two detections each."""
    k = F.col("event_id")
    detection = lambda i: F.struct(
        (k * 4 + i).alias("detection_id"), F.concat(F.lit("item "), F.col("event_type")).alias("name"), F.col("event_type").alias("category"),
        (k % (3 + i) / 10.0).alias("x"), (k % 2 / 10.0).alias("y"), F.lit(0.4).alias("width"), F.lit(0.3).alias("height"),
    )
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.floor(k / 30).alias("request"), k.alias("frame_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"),
        F.substring(F.md5(F.floor(F.col("value") / 60).cast("string")), 1, 16).alias("hash"), F.when(F.col("event_type") == "signup", 0.4).otherwise(F.col("value") % 10 / 200).alias("difference"),
        (F.col("value") % 7 < 0.5).alias("local_change"), F.lit(False).alias("last"), F.slice(F.array(detection(0), detection(1)), 1, (1 + k % 2).cast("int")).alias("detections"), F.col("ts").cast("timestamp").alias("received_at"),
    )


@query()
def scene_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Decisions, tracks and scenes of every video, with the flush of scenes below their quota; the batch form of the streaming operator."""
    from vcspark.streaming.scenes import scene_events

    return scene_events(video_frames(spark, d))
