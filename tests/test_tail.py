"""Log tails, flushes and paged datasets against plain code."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from vcspark import plans
from vcspark.sources import paged
from vcspark.streaming import tail

SF = "/root/testdata/sf0.001"
LOG = "job_id string, seq long, body string"
ENTRY = "job string, seq long, at_ms long, body string"


def plain_flushes(rows):
    """(job, seq, flush) of (job, seq, at_ms, body), one after the other."""
    out, held = [], {}
    for job, seq, at, _ in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2], r[3])):
        first, n, number, last = held.get(job, (at, 0, 0, None))
        if last is not None and seq <= last:
            continue
        if n == 100 or n and at - first >= 400:
            first, n, number = at, 0, number + 1
        held[job] = (first, n + 1, number, seq)
        out.append((job, seq, number))
    return sorted(out, key=repr)


def entries(rng, n):
    """Entries in order of each job: bursts, waits, repeats."""
    at, seq, out = {}, {}, []
    for _ in range(n):
        job = rng.choice([None, "", "a", "b", "hot", "hot", "hot", "hot"])
        at[job] = at.get(job, 0) + rng.choice([0, 1, 2, 3, 50, 399, 400] if rng.random() < 0.1 else [0, 1, 2])
        seq[job] = seq.get(job, 0) + rng.choice([0, 1, 1, 1, 5])
        out.append((job, seq[job], at[job], "x"))
    return out


def flushed(df):
    return sorted(((r.job, r.seq, r.flush) for r in df.collect()), key=repr)


def test_flushes_equal_a_plain_pass(spark):
    rows = [*entries(random.Random(5), 4000), ("a", None, 1, "x"), ("b", 10**6, None, "x")]
    random.Random(6).shuffle(rows)
    got = flushed(tail.flushes(spark.createDataFrame(rows, ENTRY)))
    assert got == plain_flushes(rows) and max(f for j, _, f in got if j == "hot") > 20
    assert tail.flushes(spark.createDataFrame([], ENTRY)).count() == 0


def test_flushes_of_arrow_pieces(spark):
    rows = entries(random.Random(8), 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert flushed(tail.flushes(spark.createDataFrame(rows, ENTRY))) == plain_flushes(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_stream_flushes_as_the_batch_does(spark, tmp_path):
    rng = random.Random(9)
    rows = entries(rng, 600)
    cuts = sorted(rng.sample(range(1, 600), 3))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], ENTRY).write.parquet(source)
    for a, b in zip([0, *cuts], [*cuts, 600]):
        spark.createDataFrame(rows[a:b], ENTRY).coalesce(1).write.mode("append").parquet(source)
        made = tail.flush_stream(spark.readStream.schema(ENTRY).parquet(source))
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert flushed(spark.read.parquet(out)) == plain_flushes(rows)


def test_flush_query_equals_a_plain_pass(spark):
    rows = [(r.event_type, r.event_id, r.event_id * 7 + r.user_id % 5, r.props) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    assert flushed(plans.QUERIES["log_flushes"](spark, SF)) == plain_flushes(rows)


def test_a_tail_has_no_gap_and_no_double(spark, tmp_path):
    """Entries stored and sent while the tail opens, a restart, and a batch that is written twice."""
    root, source = f"file://{tmp_path}/tail", str(tmp_path / "live")
    log = lambda *spans: spark.createDataFrame([(j, s, f"{j}{s}") for j, a, b in spans for s in range(a, b)], LOG)
    stored = log(("a", 0, 8), ("b", 0, 3), (None, 0, 4)).unionByName(spark.createDataFrame([("a", None, "no number")], LOG))
    anchors = tail.open_tail(stored, root, after=1, limit=4)
    log(("a", 5, 10), ("b", 2, 5), ("c", 0, 4), (None, 3, 6)).coalesce(1).write.parquet(source)
    live = lambda: spark.readStream.schema(LOG).parquet(source)
    tail.follow(live(), anchors, root, after=1, availableNow=True).awaitTermination()

    again = tail.open_tail(stored.unionByName(log(("a", 8, 10))), root, after=1, limit=4)  # open already: keeps its anchors
    assert sorted(map(tuple, again.collect()), key=repr) == [("a", 7), ("b", 2), (None, 3)]
    log(("a", 10, 12)).write.mode("append").parquet(source)
    tail.follow(live(), again, root, after=1, availableNow=True).awaitTermination()

    import shutil

    commit = tmp_path / "tail" / "checkpoint" / "commits"
    for f in commit.glob("*1*"):
        f.unlink()  # the second batch was written, its commit wasn't
    assert (tmp_path / "tail" / "live" / "__batch=1").exists()
    shutil.rmtree(tmp_path / "tail" / "checkpoint" / "state", ignore_errors=True)
    tail.follow(live(), again, root, after=1, availableNow=True).awaitTermination()

    got = sorted(((r.job_id, r.seq, r.live) for r in tail.read_tail(spark, root, stored).collect()), key=repr)
    want = [("a", s, s > 7) for s in range(4, 12)] + [("b", s, s > 2) for s in range(2, 5)] + [("c", s, True) for s in (2, 3)] + [(None, s, s > 3) for s in range(2, 6)]
    assert got == sorted(want, key=repr)


def test_an_unfinished_backlog_is_written_again(spark, tmp_path):
    root = f"file://{tmp_path}/tail"
    first = spark.createDataFrame([("a", 1, "x")], LOG)
    tail.open_tail(first, root)
    (tmp_path / "tail" / "anchors" / "_SUCCESS").unlink()
    both = first.unionByName(spark.createDataFrame([("a", 2, "y")], LOG))
    assert tail.open_tail(both, root).first()["__anchor"] == 2
    assert tail.read_tail(spark, root, both).count() == 2
    assert tail.newest(both.unionByName(both), 1).count() == 1
    assert tail.open_tail(first.limit(0), f"{root}-empty").count() == 0


def a_dataset(folder, n, page=100, total=True):
    folder.mkdir(exist_ok=True)
    for at in range(0, n + 1, page):
        answer = {"rows": [{"row_idx": i, "row": {"id": i, "name": f" item {i} "}} for i in range(at, min(at + page, n))]}
        (folder / f"{at:012d}.json").write_text(json.dumps(answer | ({"num_rows_total": n} if total else {})))
    return str(folder)


def read(spark, folder, **options):
    spark.dataSource.register(paged.PagedRows)
    return spark.read.format("paged_rows").schema("id long, name string").options(**options).load(folder)


@pytest.mark.parametrize("total", [True, False])
@pytest.mark.parametrize("n", [0, 1, 100, 250])
def test_pages_end_with_a_short_or_an_empty_one(spark, tmp_path, n, total):
    folder = a_dataset(tmp_path / "d", n, total=total)
    df = read(spark, folder, pagesPerTask="1")
    assert sorted(map(tuple, df.collect())) == [(i, f"item {i}") for i in range(n)]
    assert df.rdd.getNumPartitions() == (max(1, -(-n // 100)) if total else 1)


def test_offset_and_limit(spark, tmp_path):
    folder = a_dataset(tmp_path / "d", 250)
    ids = lambda **options: sorted(r.id for r in read(spark, folder, **options).collect())
    assert ids(offset="100", limit="120") == [*range(100, 220)]
    assert ids(offset="200", limit="500", pagesPerTask="1") == [*range(200, 250)]
    assert ids(offset="400") == ids(limit="0") == []
    assert read(spark, f"file://{folder}").where("id = 7").count() == 1
    with pytest.raises(Exception, match="beginning of a page"):
        ids(offset="50")


def test_illegible_rows_are_left_out(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id long not null, price double, n int, ok boolean, s string")
    made = lambda *raw: list(paged.rows_of({"rows": list(raw)}, schema))
    assert made({"id": "7", "price": "1.5", "n": 3.0, "ok": True, "s": " x "}, {"row": {"id": 8, "s": "na", "more": 1}}) == [(7, 1.5, 3, True, "x"), (8, None, None, None, None)]
    assert made(None, 5, [], {}, {"id": "NA"}, {"id": "x"}, {"id": [1]}, {"id": 1.5}, {"id": True}, {"id": 1, "n": 1 << 31}, {"id": 1, "ok": "yes"}, {"id": float("inf")}) == []
    assert paged.rows_of({"rows": None}, schema) is not None and list(paged.rows_of({}, schema)) == []
    with pytest.raises(TypeError):
        list(paged.rows_of({"rows": [{"v": 1}]}, StructType.fromDDL("v date")))


def test_written_pages_are_read_back(spark, tmp_path):
    df = spark.range(5, 330).select(F.col("id"), F.concat(F.lit('q"é'), "id").alias("name"))
    paged.write_pages(df, "id", 5, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").glob("[0-9]*")) == ["000000000000.json", "000000000100.json", "000000000200.json", "000000000300.json"]
    assert sorted(map(tuple, read(spark, f"file://{tmp_path}/out").collect())) == sorted(map(tuple, df.collect()))
