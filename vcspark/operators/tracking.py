"""Order-dependent steps of video analysis, by job in grouped Arrow and pandas: tracks, suppression of boxes, identity groups.

A job is one video: its detections are bounded by the video, so a group fits a task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from types import SimpleNamespace
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# When a track is lost, least overlap of the same thing, bonus of the same name, overlap of duplicates.
LOST_AFTER, MATCH_IOU, NAME_BONUS, DUPLICATE_IOU = 6.0, 0.3, 0.5, 0.65
# Weights of identity signals, cap of hash-only evidence, thresholds.
IDENTITY_WEIGHTS = {"visual": 0.5, "attributes": 0.2, "category": 0.1, "person": 0.08, "temporal": 0.05, "logo": 0.07}
HASH_ONLY_CAP, SAME, POSSIBLE = 0.89, 0.84, 0.76

Box = tuple[float, float, float, float]


def _plain(s: Any) -> str:
    return _folded("" if s is None or s != s else str(s))


@lru_cache(1 << 14)
def _folded(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not 0x300 <= ord(c) <= 0x36F).strip()


def _box(row: Any) -> Box | None:
    b = (row.x, row.y, row.width, row.height)
    if any(v is None or v != v for v in b):
        return None
    x, y, w, h = b
    return b if x >= 0 and y >= 0 and w > 0 and h > 0 and x + w <= 1.001 and y + h <= 1.001 else None


def box_iou(a: Box | None, b: Box | None) -> float:
    if a is None or b is None:
        return 0.0
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter) if inter > 0 else 0.0


class Tracker:
    """Live tracks of one job; ``step`` gives each detection of an instant a track id."""

    def __init__(self, tracks: list[dict[str, Any]] | None = None, issued: int = 0) -> None:
        self.tracks, self.issued = tracks or [], issued

    def step(self, now: float, detections: list[Any]) -> list[str]:
        self.tracks = [t for t in self.tracks if now - t["seen"] <= LOST_AFTER]
        claimed: set[str] = set()
        live = list(self.tracks)
        ids = []
        for d in detections:
            box, name, kind = _box(d), _plain(d.name), _plain(d.category)
            short = name.split()[:3]
            chosen, top = None, 0.0
            for t in live:
                if t["id"] in claimed or t["category"] != kind:
                    continue
                same = t["name"].split()[:3] == short
                score = box_iou(box, t["box"]) + NAME_BONUS * same
                if score >= (NAME_BONUS if same else MATCH_IOU) and score > top:
                    chosen, top = t, score
            if chosen is None:
                self.issued += 1
                chosen = {"id": f"t{self.issued}", "category": kind, "name": name, "box": box}
                self.tracks.append(chosen)
            chosen["seen"] = now
            chosen["box"] = box or chosen["box"]
            if len(name) > len(chosen["name"]):
                chosen["name"] = name
            claimed.add(chosen["id"])
            ids.append(chosen["id"])
        return ids


def _in_order(rows: pa.Table, keys: list[tuple[str, str]]) -> tuple[pa.Table, list[SimpleNamespace]]:
    """The rows sorted, nulls last, as they are (numbers beside nulls stay exact) and what the rules look at."""
    rows = rows.take(pc.sort_indices(rows, keys))
    looked = [c for c in ("at", "detection_id", "name", "category", "x", "y", "width", "height") if c in rows.column_names]
    return rows, [SimpleNamespace(**r) for r in rows.select(looked).to_pylist()]


def assign_tracks(detections: DataFrame, job: str = "job_id") -> DataFrame:
    """``detections`` (job, at, detection_id, name, category, x, y, width, height, ...) with track_id: t1, t2, ... by job.

    Instants in order; within one, detections by id claim the live track of their
    category with the best overlap (half a point more for the same first three words).
    Detections without a time get no track.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows, seen = _in_order(rows, [("at", "ascending"), ("detection_id", "ascending")])
        tracker, ids = Tracker(), []
        for now, group in groupby(seen, lambda r: r.at):
            found = list(group)
            ids += tracker.step(float(now), found) if now is not None else [None] * len(found)
        return rows.append_column("track_id", pa.array(ids, pa.string()))

    schema = T.StructType([*detections.schema.fields, T.StructField("track_id", T.StringType())])
    return detections.groupBy(job).applyInArrow(run, schema)


def suppress_boxes(detections: DataFrame, frame: list[str], least: float = DUPLICATE_IOU) -> DataFrame:
    """Per frame and category, boxes that overlap a more confident one by ``least`` go; invalid boxes stay.

    Equal confidence: the smaller detection_id counts as the more confident. Frames are
    shuffled together and sorted, a task goes through all of its frames in one pass.
    """
    looked = ["category", "x", "y", "width", "height"]
    strength = [F.col("confidence").isNull(), F.isnan("confidence"), F.col("confidence").desc()]
    ordered = detections.repartition(*frame).sortWithinPartitions(*frame, *strength, F.col("detection_id").asc_nulls_last())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        kept: dict[str, list[Box]] = {}
        for part in parts:
            keep = []
            at = zip(*(part.column(c).to_pylist() for c in frame))
            for place, category, x, y, w, h in zip(at, *(part.column(c).to_pylist() for c in looked)):
                place = tuple("NaN" if v != v else v for v in place)
                if place != now:
                    now, kept = place, {}
                box = _box(SimpleNamespace(x=x, y=y, width=w, height=h))
                held = kept.setdefault(str(category or "").lower().strip(), [])
                good = box is None or not any(box_iou(b, box) >= least for b in held)
                keep.append(good)
                if good and box is not None:
                    held.append(box)
            yield part.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, detections.schema)


def identity_pairs(tracks: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, a, b, score, blocked) of the tracks of a job, a seen first.

    ``tracks``: track_id, first_seen, last_seen, slot, category, family, person_index,
    color, visual (array<double>, may be null), duration. The score is the weighted mean
    of the signals that exist; without vectors it is capped. Different known slots, and
    different people at one time, block a pair.
    """
    from vcspark.functions.vectors import cosine_unit

    a, b = (tracks.select(job, *[F.col(c).alias(f"{s}_{c}") for c in tracks.columns if c != job]) for s in "ab")
    first = F.struct("a_first_seen", "a_track_id") < F.struct("b_first_seen", "b_track_id")
    pairs = a.join(b, job).where(first)
    overlap = F.least("a_last_seen", "b_last_seen") - F.greatest("a_first_seen", "b_first_seen")
    both = lambda c: F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull()
    same = lambda c: F.col(f"a_{c}") == F.col(f"b_{c}")
    part_of = F.contains("a_color", "b_color") | F.contains("b_color", "a_color")
    signals = {
        "visual": cosine_unit("a_visual", "b_visual"),
        "attributes": F.when(both("color"), F.when(same("color"), 1.0).when(part_of, 0.7).otherwise(0.0)),
        "category": F.when(both("category"), F.when(same("category"), 1.0).when(same("family"), 0.6).otherwise(0.0)),
        "person": F.when(both("person_index"), same("person_index").cast("double")),
        "temporal": F.when(overlap >= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 + overlap / F.greatest("a_duration", F.lit(1.0)))),
    }
    weight = sum((F.when(v.isNotNull(), IDENTITY_WEIGHTS[k]).otherwise(0.0) for k, v in signals.items()), F.lit(0.0))
    total = sum((F.coalesce(v * IDENTITY_WEIGHTS[k], F.lit(0.0)) for k, v in signals.items()), F.lit(0.0))
    raw = F.coalesce(F.try_divide(total, weight), F.lit(0.0))
    score = F.when(signals["visual"].isNotNull(), raw).otherwise(F.least(raw, F.lit(HASH_ONLY_CAP)))
    blocked = F.coalesce(both("slot") & ~same("slot"), F.lit(False)) | F.coalesce(both("person_index") & ~same("person_index") & (overlap >= 0), F.lit(False))
    return pairs.select(job, F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), F.round(score, 6).alias("score"), blocked.alias("blocked"))


def identity_groups(tracks: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, track_id, product_index, possible_duplicate_of): tracks in order join the group of their best unblocked partner from 0.84 on.

    Greedy and in order of first_seen, then track_id; from 0.76 on the best group is
    noted as a possible duplicate. The pairs come from a join, of which those from 0.76
    on go into the fold; it is by job - a video, some hundreds of tracks.
    """
    pairs = identity_pairs(tracks, job).where(~F.col("blocked") & (F.col("score") >= POSSIBLE)).groupBy(job, F.col("b").alias("track_id")).agg(F.collect_list(F.struct("a", "score")).alias("before"))
    rows = tracks.select(job, "track_id", "first_seen").join(pairs, [job, "track_id"], "left")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["first_seen", "track_id"], kind="stable")
        placed: dict[str, int] = {}
        out, issued = [], 0
        for row in group.itertuples():
            best, top = -1, 0.0
            for p in sorted(row.before if row.before is not None else [], key=lambda p: placed[p["a"]]):
                if p["score"] > top:
                    best, top = placed[p["a"]], p["score"]
            if best >= 0 and top >= SAME:
                placed[row.track_id] = best
                out.append((row.track_id, best, None))
            else:
                placed[row.track_id] = issued
                out.append((row.track_id, issued, best if best >= 0 and top >= POSSIBLE else None))
                issued += 1
        made = pd.DataFrame(out, columns=["track_id", "product_index", "possible_duplicate_of"]).astype({"possible_duplicate_of": "Int64"})
        return made.assign(**{job: group[job].iloc[0]})[[job, "track_id", "product_index", "possible_duplicate_of"]]

    kind = tracks.schema[job].dataType.simpleString()
    return rows.groupBy(job).applyInPandas(fold, f"`{job}` {kind}, track_id string, product_index long, possible_duplicate_of long")


def canonical_labels(labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label): the most frequent label up to case and accents, at equal counts the longest; those with a slash only if there is no other."""
    from pyspark.sql import Window

    from vcspark.functions.text import norm_basic

    usable = labels.where(F.length(F.trim(F.col(label))) > 0).withColumn("__slash", F.contains(F.col(label), F.lit("/")))
    grouped = usable.groupBy(*keys, norm_basic(label).alias("__key")).agg(F.count("*").alias("__n"), F.max(F.struct(F.length(label).alias("n"), F.col(label).alias("l")))["l"].alias("__label"), F.min("__slash").alias("__slash"))
    order = Window.partitionBy(*keys).orderBy("__slash", F.desc("__n"), F.desc(F.length("__label")), "__label")
    return grouped.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(*keys, F.col("__label").alias(label))
