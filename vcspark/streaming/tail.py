"""A log's tail: what is stored, then what comes, joined at an offset without a gap or a double; and the rule by which entries are flushed.

Every entry has its job's running number ``seq``; a job's entries are stored, and come, in
that order. What is stored when the tail opens is written once, and its greatest ``seq`` of
each job is the anchor: of the stream only entries beyond it count. Each batch of the stream
has a folder of its own that a retried batch writes again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Entries of a flush, milliseconds that a flush may wait, entries that a tail shows of what is stored, entries of the ring.
FLUSH_ROWS, FLUSH_MS, BACKLOG, RING = 100, 400, 300, 2000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def newest(rows: DataFrame, limit: int, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """The newest entries of each job, at most ``limit``; null jobs are one job, of equal numbers any may stay."""
    order = Window.partitionBy(job).orderBy(F.desc(seq))
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def open_tail(stored: DataFrame, path: str, after: int = -1, limit: int | None = BACKLOG, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """Write the backlog and the anchors under ``path`` and return the anchors (job, anchor); a tail that is open already keeps its own.

    The backlog has the entries beyond ``after``, the newest ``limit`` of each job (None: all).
    Anchors come from the entries of the snapshot that was written, so an entry that is stored
    meanwhile is live. Entries without a job form a job; those without a number aren't shown.
    """
    spark = stored.sparkSession
    if not _exists(spark, f"{path}/anchors/_SUCCESS"):
        known = stored.where(F.col(seq) > after)
        snapshot = f"{path}/backlog"
        (known if limit is None else newest(known, limit, job, seq)).write.mode("overwrite").parquet(snapshot)
        spark.read.schema(stored.schema).parquet(snapshot).groupBy(F.col(job).alias("__job")).agg(F.max(seq).alias("__anchor")).write.mode("overwrite").parquet(f"{path}/anchors")
    return spark.read.parquet(f"{path}/anchors")


def _flushed(state: tuple | None, at: int, seq: int) -> tuple[tuple, bool]:
    """(first, rows, number, last seq) after an entry, and whether it is new."""
    if state is None:
        return (at, 1, 0, seq), True
    first, rows, number, last = state
    if seq <= last:
        return state, False
    if rows >= FLUSH_ROWS or at - first >= FLUSH_MS:
        return (at, 1, number + 1, seq), True
    return (first, rows + 1, number, seq), True


def _stepped(part: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
    kept, numbers = [], []
    for at, seq in zip(part["at_ms"], part["seq"]):
        state, new = _flushed(state, int(at), int(seq))
        kept.append(new)
        numbers.append(state[2])
    return part.assign(flush=numbers)[kept], state


_FLUSH = "job string, seq long, at_ms long, body string, flush long"
_STATE = "first long, rows long, number long, last long"


def flushes(rows: DataFrame) -> DataFrame:
    """(job, seq, at_ms, body, flush): entries with the number of the flush that carries them.

    A flush takes a job's entries in order and closes with its hundredth one, or before the
    first that comes 400 ms or more after the one that opened it. A number that isn't beyond the
    job's last one is a repeat and goes, as do entries without number or time. Sorted
    partitions pass through in pieces, so a job of any length needs no room.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state, begun = None, None, False
        for part in parts:
            part = part.reset_index(drop=True)
            key = part["job"].map(lambda x: (1, x) if isinstance(x, str) else (0, ""))
            for _, piece in part.groupby((key != key.shift()).cumsum(), sort=False):
                mine = key[piece.index[0]]
                if not begun or mine != job:
                    job, state, begun = mine, None, True
                out, state = _stepped(piece, state)
                yield out

    whole = rows.select(F.col("job").cast("string").alias("job"), "seq", "at_ms", "body").where("seq is not null and at_ms is not null")
    return whole.repartition("job").sortWithinPartitions("job", "seq", "at_ms", "body").mapInPandas(run, _FLUSH)


def flush_stream(rows: DataFrame) -> DataFrame:
    """The same of a stream: the state of a job is its open flush and its last number, whatever its length."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        part = pd.concat(list(parts)).sort_values(["seq", "at_ms", "body"], kind="stable")
        out, held = _stepped(part, held)
        if held is not None:
            state.update(held)
        yield out

    whole = rows.select(F.col("job").cast("string").alias("job"), "seq", "at_ms", "body").where("seq is not null and at_ms is not null")
    return whole.groupBy("job").applyInPandasWithState(run, _FLUSH, _STATE, "append", GroupStateTimeout.NoTimeout)


def follow(live: DataFrame, anchors: DataFrame, path: str, after: int = -1, job: str = "job_id", seq: str = "seq", **trigger) -> StreamingQuery:
    """Start writing the live entries beyond the anchors, each batch to a folder of its own; goes on where it stopped."""
    met = live.join(anchors, F.col(job).eqNullSafe(F.col("__job")), "left").where(F.col(seq) > F.greatest(F.coalesce("__anchor", F.lit(after)), F.lit(after))).drop("__job", "__anchor")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/live/__batch={number}")

    return met.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger).start()


def read_tail(spark: SparkSession, path: str, like: DataFrame, flag: str = "live") -> DataFrame:
    """Backlog and live entries so far; ``like`` has their columns, the new column ``flag`` says which are live."""
    backlog = spark.read.schema(like.schema).parquet(f"{path}/backlog").withColumn(flag, F.lit(False))
    if not _exists(spark, f"{path}/live"):
        return backlog
    return backlog.unionByName(spark.read.schema(like.schema).parquet(f"{path}/live").drop("__batch").withColumn(flag, F.lit(True)))
