"""A stream gives what the batch gives on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vcspark import plans
from vcspark.streaming import logs
from vcspark.streaming.sampling import Sampling, sample_frames, sample_stream

SF = "/root/testdata/sf0.001"


def test_sampling_rules(spark):
    frames = spark.createDataFrame(
        [("j", 1, 0.0, "0" * 16, False), ("j", 2, 0.1, "0" * 16, False), ("j", 3, 0.2, "0" * 16, False), ("j", 4, 1.3, "0" * 16, False), ("j", 5, 1.4, "f" * 16, False), ("j", 6, 1.5, "f" * 16, True), ("j", 7, 1.5, "f" * 16, False)],
        "job_id string, frame_id long, at double, hash string, scene_changed boolean",
    )
    got = [r.reason for r in sample_frames(frames, Sampling(least=2, most=8)).orderBy("frame_id").collect()]
    assert got == ["kept:scene_first", "kept:min_frames_quota", "discarded:near_duplicate", "kept:max_gap", "kept:visual_change", "kept:scene_first", "discarded:late"]


def test_local_change_and_no_hashes(spark):
    frames = spark.createDataFrame([("j", i, i / 10, "0" * 16, False, i == 3) for i in range(6)], "job_id string, frame_id long, at double, hash string, scene_changed boolean, local_change boolean")
    reasons = lambda rules: [r.reason for r in sample_frames(frames, rules).orderBy("frame_id").collect()]
    assert reasons(Sampling(least=1)) == ["kept:scene_first", *["discarded:near_duplicate"] * 2, "kept:local_change", *["discarded:near_duplicate"] * 2]
    assert set(reasons(Sampling(hashed=False))) == {"kept:hash_disabled"}


def test_query_equals_a_plain_fold(spark):
    """The registered query against one pass in order of time."""
    import hashlib

    got = {r.frame_id: (r.keep, r.reason) for r in plans.QUERIES["stream_sampling"](spark, SF).collect()}
    last: dict[int, dict] = {}
    rows = sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id))
    assert len(got) == len(rows)
    for r in rows:
        at, picture = r.ts.timestamp(), int(hashlib.md5(str(int(r.value // 10)).encode()).hexdigest()[:16], 16)
        s = last.setdefault(r.user_id, {"at": None, "n": 0, "kept": None, "kept_at": None})
        first = s["at"] is None or r.event_type == "signup"
        n = 0 if first else s["n"]
        near = s["kept"] is not None and (picture ^ s["kept"]).bit_count() <= 6
        if s["at"] is not None and at <= s["at"]:
            want = (False, "discarded:late")
        elif first:
            want = (True, "kept:scene_first")
        elif n >= 8:
            want = (False, "discarded:max_frames_cap")
        elif not near:
            want = (True, "kept:visual_change")
        elif n < 2:
            want = (True, "kept:min_frames_quota")
        else:
            want = (True, "kept:max_gap") if at - s["kept_at"] >= 1 else (False, "discarded:near_duplicate")
        assert got[r.event_id] == want
        if want[1] != "discarded:late":
            s.update(at=at, n=n + want[0])
            if want[0]:
                s.update(kept=picture, kept_at=at)


def test_stream_equals_batch(spark, tmp_path):
    frames = spark.createDataFrame([(f"j{i % 3}", i, float(i // 3) / 4, f"{(i // 7) % 5:016x}", i % 40 == 0) for i in range(200)], "job_id string, frame_id long, at double, hash string, scene_changed boolean")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    query = sample_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.frame_id, r.keep, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.frame_id, r.keep, r.reason) for r in sample_frames(frames).collect()}


def test_windows_and_sessions(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, made in (("counts", logs.level_counts(stream)), ("sessions", logs.sessions(stream, "user_id", gap="6 hours"))):
        query = made.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
    assert spark.table("sessions").count() > 0


def test_repeated_batch_is_written_once(spark, tmp_path):
    write = logs.batch_writer(str(tmp_path / "t"), "k")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v long, k string")
    write(rows, 0)
    write(rows, 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
