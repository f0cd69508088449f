"""Segments, coverage and questions about instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vcspark.functions.text import round_half_up


def segments(rows: DataFrame, keys: list[str], at: str, gap: float = 1.5) -> DataFrame:
    """(keys, segment, start, end, n): runs of times by key in which each is at most ``gap`` after the one before."""
    order = Window.partitionBy(*keys).orderBy(at)
    opened = F.when(F.col(at) - F.lag(at).over(order) <= gap, 0).otherwise(1)
    numbered = rows.withColumn("__new", opened).withColumn("segment", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "segment").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def uncovered_ranges(scenes: DataFrame, durations: DataFrame, job: str = "job_id", require_scenes: bool = True) -> DataFrame:
    """(job, start_ms, end_ms, reason) of what no scene covers.

    ``scenes`` has start_seconds, end_seconds, analyzed_frame_count; ``durations``
    duration_ms of every job. Times are rounded to milliseconds, halves up.
    """
    ms = lambda c: round_half_up(F.col(c) * 1000).cast("long")
    timed = scenes.select(job, ms("start_seconds").alias("s"), ms("end_seconds").alias("e"), F.col("start_seconds").alias("o"), "analyzed_frame_count")
    order = Window.partitionBy(job).orderBy("o", "e")
    with_before = timed.withColumn("before", F.lag("e").over(order)).withColumn("last", F.lead("s").over(order).isNull()).join(durations.select(job, "duration_ms"), job)
    at = lambda s, e, reason: F.struct(s.cast("long").alias("start_ms"), e.cast("long").alias("end_ms"), F.lit(reason).alias("reason"))
    s, e, before = F.col("s"), F.col("e"), F.col("before")
    parts = [
        F.when(before.isNull() & (s > 0), at(F.lit(0), s, "before_first_scene")),
        F.when(s > before, at(before, s, "gap_between_scenes")),
        F.when(F.col("last") & (e < F.col("duration_ms")), at(e, F.col("duration_ms"), "after_last_scene")),
    ]
    if require_scenes:
        parts.append(F.when(F.col("analyzed_frame_count") <= 0, at(s, e, "scene_zero_frames")))
    ranges = with_before.select(job, F.explode(F.array_compact(F.array(*parts))).alias("r")).select(job, "r.*")
    empty = durations.where("duration_ms > 0").join(scenes.select(job), job, "left_anti").select(job, F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").cast("long").alias("end_ms"), F.lit("before_first_scene").alias("reason"))
    return ranges.unionByName(empty)


def coverage(scenes: DataFrame, durations: DataFrame, job: str = "job_id", require_scenes: bool = True) -> DataFrame:
    """(job, duration_ms, covered_ms, coverage_percent, scene_count), one row for each job; 100 percent where the duration is 0."""
    missing = uncovered_ranges(scenes, durations, job, require_scenes).groupBy(job).agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("uncovered"))
    counted = scenes.groupBy(job).agg(F.count("*").alias("scene_count"))
    joined = durations.select(job, F.col("duration_ms").cast("long").alias("duration_ms")).join(missing, job, "left").join(counted, job, "left")
    covered = F.greatest(F.lit(0), F.col("duration_ms") - F.coalesce("uncovered", F.lit(0)))
    percent = F.when(F.col("duration_ms") > 0, F.floor(covered / F.col("duration_ms") * 1000 + 0.5) / 10).otherwise(100.0)
    return joined.select(job, "duration_ms", covered.alias("covered_ms"), percent.alias("coverage_percent"), F.coalesce("scene_count", F.lit(0)).cast("long").alias("scene_count"))


def at_instants(occurrences: DataFrame, instants: DataFrame, key: str, tolerance: float = 0.25) -> DataFrame:
    """Occurrences (key, first_seen, last_seen, timestamps, ...) on screen at each instant (key, t), with exact_appearance.

    An equi-join on the key with the range as a condition.
    """
    t = F.col("t")
    met = instants.join(occurrences, key).where((F.col("first_seen") <= t + tolerance) & (F.col("last_seen") >= t - tolerance))
    return met.withColumn("exact_appearance", F.exists("timestamps", lambda x: F.abs(x - t) <= tolerance))


def nearest(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, right_id: str, within: float | None = None) -> DataFrame:
    """``left`` with the row of ``right`` of the same key that is nearest in time, on either side; ties go to the earlier, then the smaller id.

    An as-of join both ways over the time-ordered union of the two: each key's rows
    are sorted once, no pair is made but the chosen two.
    """
    cols = left.columns
    cand = F.struct(F.col(right_at).alias("at"), F.col(right_id).alias("id"))
    both = left.select(key, F.col(left_at).alias("__t"), F.struct(*cols).alias("__l"), F.lit(None).cast(f"struct<at:{right.schema[right_at].dataType.simpleString()},id:{right.schema[right_id].dataType.simpleString()}>").alias("__r"))
    both = both.unionByName(right.groupBy(key, right_at).agg(F.min(right_id).alias(right_id)).select(key, F.col(right_at).alias("__t"), F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("__l"), cand.alias("__r")))
    order = Window.partitionBy(key).orderBy("__t", F.col("__l").isNotNull())
    before = F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("__b", before).withColumn("__a", after).where("__l is not null")
    gap = lambda c: F.abs(F.col(c)["at"] - F.col("__t"))
    best = F.when(F.col("__a").isNull() | (gap("__b") <= gap("__a")), F.col("__b")).otherwise(F.col("__a"))
    out = found.select("__l.*", best.alias("__n")).withColumn("distance", F.abs(F.col("__n.at") - F.col(left_at)))
    chosen = F.col("__n") if within is None else F.when(F.col("distance") <= within, F.col("__n"))
    return out.select(*cols, chosen["id"].alias("nearest_id"), F.when(chosen.isNotNull(), F.col("distance")).alias("distance"))


def in_segments(t: Column, parts: Column, slack: float = 0.25) -> Column:
    """Whether a time lies in one of an array of segments (start, end), give or take ``slack``."""
    return F.exists(parts, lambda s: (s["start"] - slack <= t) & (t <= s["end"] + slack))


def price_changes(history: DataFrame, keys: list[str], at: str, price: str, tie: str) -> DataFrame:
    """Rows whose price differs from the one before, with previous_price; the first of a key is no change."""
    order = Window.partitionBy(*keys).orderBy(at, tie)
    seen = history.withColumn("previous_price", F.lag(price).over(order)).withColumn("__n", F.row_number().over(order))
    return seen.where((F.col("__n") > 1) & ~F.col(price).eqNullSafe(F.col("previous_price"))).drop("__n")


def capped_history(history: DataFrame, keys: list[str], at: str, tie: str, most: int = 200) -> DataFrame:
    """The newest ``most`` rows of each key: a retention rule."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return history.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def integrity_report(jobs: DataFrame, scenes: DataFrame, products: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, rule, n) of violated rules: scenes that end before they start, overlap or reach beyond the video; products without tracks, without times, or outside of the video."""
    order = Window.partitionBy(job).orderBy("start_seconds", "end_seconds")
    s = scenes.withColumn("__before", F.max("end_seconds").over(order.rowsBetween(Window.unboundedPreceding, -1))).join(jobs.select(job, "duration_ms"), job)
    p = products.join(jobs.select(job, "duration_ms"), job)
    rules = [
        (s, "scene_reversed", F.col("end_seconds") < F.col("start_seconds")),
        (s, "scene_overlap", F.col("__before") > F.col("start_seconds")),
        (s, "scene_beyond_video", F.col("end_seconds") * 1000 > F.col("duration_ms") + 1),
        (p, "product_without_tracks", F.col("track_count") <= 0),
        (p, "product_without_times", F.col("first_seen").isNull() | F.col("last_seen").isNull()),
        (p, "product_outside_video", F.col("last_seen") * 1000 > F.col("duration_ms") + 1),
    ]
    out = None
    for table, name, broken in rules:
        part = table.where(broken).groupBy(job).agg(F.count("*").alias("n")).select(job, F.lit(name).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out
