"""Scenes, tracks and the flush: batch against a plain fold, stream against batch under any cut."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vcspark import plans
from vcspark.operators.tracking import assign_tracks, suppress_boxes
from vcspark.plans import video
from vcspark.streaming.sampling import Sampling
from vcspark.streaming.scenes import scene_events, scene_stream

SF = "/root/testdata/sf0.001"
FRAMES = (
    "job_id string, request long, frame_id long, at double, hash string, difference double, local_change boolean, last boolean, "
    "detections array<struct<detection_id long, name string, category string, x double, y double, width double, height double>>, received_at timestamp"
)


def overlap(a, b):
    if a is None or b is None:
        return 0
    w, h = (min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i]) for i in (0, 1))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0


class SlowTracker:
    def __init__(self):
        self.live, self.n = [], 0

    def take(self, at, detections):
        self.live = [t for t in self.live if at - t["seen"] <= 6]
        used, out, before = set(), [], list(self.live)
        for d in sorted(detections, key=lambda d: d["detection_id"]):
            box = (d["x"], d["y"], d["width"], d["height"])
            options = []
            for place, t in enumerate(before):
                same = t["name"].split()[:3] == d["name"].split()[:3]
                score = overlap(box, t["box"]) + 0.5 * same
                if t["id"] not in used and t["category"] == d["category"] and score >= (0.5 if same else 0.3):
                    options.append((-score, place, t))
            t = min(options, key=lambda o: o[:2])[2] if options else None
            if t is None:
                self.n += 1
                t = {"id": f"t{self.n}", "name": d["name"], "category": d["category"]}
                self.live.append(t)
            t.update(seen=at, box=box)
            used.add(t["id"])
            out.append(("track", d["detection_id"], t["id"]))
        return out


def slow_job(frames, rules):
    """One pass over a video's frames; the events in order, as tuples."""
    out, tracker = [], SlowTracker()
    counted, up_to, scenes, kept, pending = Counter(), None, [], None, None

    def close():
        nonlocal kept
        scene = scenes[-1]
        if pending and scene["n"] < rules.least:
            out.append(("frame", pending["frame_id"], scene["id"], True, "kept:scene_last"))
            out.extend(tracker.take(pending["at"], pending["detections"]))
            scene["n"] += 1
            kept = (pending["hash"], pending["at"])
        out.append(("scene", scene["id"], scene["start"], scene["end"], scene["frames"], scene["n"], "completed" if scene["n"] else "failed"))

    for f in sorted(frames, key=lambda f: (f["request"], f["at"], f["frame_id"])):
        counted[f["request"]] += 1
        if counted[f["request"]] > 25:
            out.append(("frame", f["frame_id"], None, False, "discarded:over_request"))
            continue
        if up_to is not None and f["at"] <= up_to:
            out.append(("frame", f["frame_id"], None, False, "discarded:late"))
            continue
        if not scenes or f["difference"] >= 0.1:
            if scenes:
                close()
            pending = None
            scenes.append({"id": len(scenes) + 1, "start": f["at"], "frames": 0, "n": 0})
        scene, up_to = scenes[-1], f["at"]
        near = kept and (int(kept[0], 16) ^ int(f["hash"], 16)).bit_count() <= rules.distance
        if not scene["frames"]:
            reason = "kept:scene_first"
        elif scene["n"] >= rules.most:
            reason = "discarded:max_frames_cap"
        elif not near:
            reason = "kept:visual_change"
        elif f["local_change"]:
            reason = "kept:local_change"
        elif scene["n"] < rules.least:
            reason = "kept:min_frames_quota"
        else:
            reason = "kept:max_gap" if f["at"] - kept[1] >= rules.interval else "discarded:near_duplicate"
        scene["frames"] += 1
        scene["end"] = f["at"]
        keep = reason.startswith("kept")
        out.append(("frame", f["frame_id"], scene["id"], keep, reason))
        pending = None if keep else f
        if keep:
            out.extend(tracker.take(f["at"], f["detections"]))
            scene["n"] += 1
            kept = (f["hash"], f["at"])
    if scenes:
        close()
    return out


def shown(rows):
    by_job = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.job_id, r.n)):
        if r.kind == "frame":
            by_job[r.job_id].append(("frame", r.frame_id, r.scene_id, r.keep, r.reason))
        elif r.kind == "track":
            by_job[r.job_id].append(("track", r.detection_id, r.track_id))
        else:
            by_job[r.job_id].append(("scene", r.scene_id, r.start, r.end, r.frames, r.analyzed, r.status))
    return dict(by_job)


def test_scene_query_equals_a_plain_fold(spark):
    jobs = defaultdict(list)
    for r in video.video_frames(spark, SF).collect():
        jobs[r.job_id].append({**r.asDict(), "detections": [d.asDict() for d in r.detections]})
    want = {job: slow_job(frames, Sampling()) for job, frames in jobs.items()}
    assert shown(plans.QUERIES["scene_tracks"](spark, SF).collect()) == want
    assert len({e[4] for events in want.values() for e in events if e[0] == "frame"}) >= 4


def made_frames():
    """Frames a tenth of a second apart, of two jobs, all alike but for scene changes: short scenes need the flush."""
    rows = []
    for job in ("a", "b"):
        for i in range(70):
            box = {"name": f"red shoe {i % 2}", "category": "shoe", "x": i % 5 / 20, "y": 0.1, "width": 0.3, "height": 0.3}
            at = i / 10 if i % 11 else i / 10 - 1
            rows.append((job, i // 30, i, at, "0" * 15 + "13f"[i % 3], 0.3 if i % 23 == 22 or i % 23 == 20 else 0.0, False, job == "b" and i == 69, [{"detection_id": 3 * i + k, **box} for k in range(i % 3)], None))
    return rows


RULES = Sampling(least=3, most=5, interval=50.0)


def stamped(spark, rows):
    return spark.createDataFrame([(*r[:-1], None) for r in rows], FRAMES).withColumn("received_at", F.timestamp_seconds(1_700_000_000 + F.col("request") * 60))


def test_flush_of_short_scenes(spark):
    frames = stamped(spark, made_frames())
    got = shown(scene_events(frames, RULES).collect())
    for job in ("a", "b"):
        rows = [dict(zip([f.split()[0] for f in "job_id request frame_id at hash difference local_change last detections".split()], r)) for r in made_frames() if r[0] == job]
        assert got[job] == slow_job(rows, RULES)
    reasons = Counter(e[4] for e in got["a"] if e[0] == "frame")
    assert reasons["discarded:over_request"] == 10 and reasons["discarded:late"] >= 2
    lone = [("c", 0, 1, 0.0, "0" * 16, 0.0, False, False, [], None), ("c", 0, 2, 0.1, "0" * 16, 0.0, False, False, [{"detection_id": 9, "name": "hat", "category": "hat", "x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2}], None)]
    capped = shown(scene_events(stamped(spark, lone), Sampling(least=2, most=1)).collect())["c"]
    assert [e[4] for e in capped if e[0] == "frame"] == ["kept:scene_first", "discarded:max_frames_cap", "kept:scene_last"] and ("track", 9, "t1") in capped and capped[-1][5] == 2


@pytest.mark.parametrize("cuts", [[0, 1, 2, 3], [0, 2, 3], [0, 3]])
def test_stream_equals_batch_under_any_cut(spark, tmp_path, cuts):
    """Requests arrive in micro-batches cut anywhere between them; job b ends by its mark, job a by the timer."""
    frames = stamped(spark, made_frames())
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    late = spark.createDataFrame([("z", 9, 1, 0.0, "0" * 16, 0.0, False, True, [], None)], FRAMES).withColumn("received_at", F.timestamp_seconds(F.lit(1_700_000_000 + 86_400)))
    end = spark.createDataFrame([("y", 9, 1, 0.0, "0" * 16, 0.0, False, True, [], None)], FRAMES).withColumn("received_at", F.timestamp_seconds(F.lit(1_700_000_000 + 90_000)))
    parts = [frames.where((F.col("request") >= a) & (F.col("request") < b)) for a, b in zip(cuts, cuts[1:])] + [late, end]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = scene_stream(spark.readStream.schema(FRAMES).parquet(source), RULES)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = shown(spark.read.parquet(out).collect())
    want = shown(scene_events(frames, RULES).collect())
    assert {k: got[k] for k in want} == want


def test_ids_stay_exact_beside_nulls(spark):
    schema = "job_id long, at double, detection_id long, name string, category string, x double, y double, width double, height double, confidence double, `my col` int"
    ids = [None, 2**53 + 1, 2**60 + 7]
    rows = [(1, 0.0 if i != ids[1] else None, i, "shoe", "shoe", 0.1, 0.1, 0.2, 0.2, 0.5, 7) for i in ids]
    df = spark.createDataFrame(rows, schema)
    tracked = {r.detection_id: r.track_id for r in assign_tracks(df).collect()}
    assert set(tracked) == set(ids) and tracked[2**53 + 1] is None and tracked[2**60 + 7] == "t1"
    assert [r.detection_id for r in suppress_boxes(df, ["job_id"]).collect()] == [2**53 + 1]


def test_tracker_query_equals_a_plain_fold(spark):
    jobs = defaultdict(lambda: defaultdict(list))
    for r in video._boxes(spark, SF).collect():
        jobs[r.job_id][r.at].append(r.asDict())
    want = {}
    for frames in jobs.values():
        tracker = SlowTracker()
        for at in sorted(frames):
            valid = [dict(d, bad=d["x"] + d["width"] > 1.001 or d["y"] + d["height"] > 1.001) for d in frames[at]]
            assert not any(d["bad"] for d in valid)
            want |= {i: t for _, i, t in tracker.take(at, valid)}
    got = {r.detection_id: r.track_id for r in plans.QUERIES["tracker_assign"](spark, SF).collect()}
    assert got == want


def test_a_task_takes_its_jobs_in_one_pass(spark):
    """Each job was a group of pandas for itself, which cost more than its frames; batches now end within jobs."""
    frames = spark.createDataFrame(made_frames(), FRAMES)
    want = shown(scene_events(frames, RULES).collect())
    assert "FlatMapGroupsInPandas" not in scene_events(frames, RULES)._jdf.queryExecution().optimizedPlan().toString()
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, 7)
        assert shown(scene_events(frames, RULES).collect()) == want
    finally:
        spark.conf.set(size, before)
    odd = [r if i % 9 else (*r[:3], [None, float("nan"), float("inf")][i % 3], *r[4:]) for i, r in enumerate(made_frames())]
    left = [r for i, r in enumerate(made_frames()) if i % 9]
    assert shown(scene_events(spark.createDataFrame(odd, FRAMES), RULES).collect()) == shown(scene_events(spark.createDataFrame(left, FRAMES), RULES).collect())
