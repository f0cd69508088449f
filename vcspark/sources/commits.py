"""Several tables replaced as one: staged folders and a pointer that is switched last.

A set of tables lives under ``root``. Each commit is a small file ``_commits/<number>`` that
names the folders of every table, one for each bucket of the key; the newest commit is the
state. A commit stages new folders for the buckets that it touches, then publishes its file by
a rename that fails where the number is taken. Whoever stops before that leaves the old state
whole, and of two writers that started from the same commit one gets ``Conflict``. Folders of
older commits stay for readers that still use them. The rename must be atomic in the file
system of ``root``, as it is on HDFS and on local disks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another commit came first."""


def _files(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, p, p.getFileSystem(conf)


def head(spark: SparkSession, root: str) -> int:
    """The newest commit's number; 0 before the first."""
    _, _, path, fs = _files(spark, f"{root}/_commits")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def _state(spark: SparkSession, root: str, number: int) -> dict:
    if number == 0:
        return {"key": None, "buckets": None, "tables": {}}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/_commits/{number:012d}", wholetext=True).collect()))


def _publish(spark: SparkSession, root: str, number: int, state: dict) -> None:
    jvm, conf, folder, fs = _files(spark, f"{root}/_commits")
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
    strict = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}")), strict)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"commit {number} of {root} is taken") from e
        raise


def read_committed(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """Table ``name`` as the newest commit, or a given one, has it."""
    number = head(spark, root) if number is None else number
    return _read(spark, root, _state(spark, root, number)["tables"][name])


def _read(spark: SparkSession, root: str, entry: dict, buckets: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(entry["schema"])
    paths = [f"{root}/{p}" for b, p in entry["parts"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _stage(spark: SparkSession, root: str, name: str, rows: DataFrame, key: str, buckets: int) -> dict:
    """Write the rows by bucket and return the folders; a bucket that holds much is split over tasks."""
    folder = f"staged/{uuid.uuid4().hex}/{uuid.uuid5(uuid.NAMESPACE_OID, name).hex}"
    rows.withColumn(BUCKET, _bucket(_quoted(key), buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    _, _, path, fs = _files(spark, f"{root}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def create_set(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], key: str, buckets: int = 64) -> int:
    """First commit of a set whose tables all have the column ``key``; null keys share a bucket."""
    state = {"key": key, "buckets": buckets, "tables": {}}
    for name, rows in tables.items():
        state["tables"][name] = {"schema": json.loads(rows.schema.json()), "parts": _stage(spark, root, name, rows, key, buckets)}
    _publish(spark, root, 1, state)
    return 1


def replace_keys(spark: SparkSession, root: str, rows: Mapping[str, DataFrame], keys: DataFrame, expected: int) -> int:
    """Commit ``expected`` + 1: in every table named in ``rows`` the rows of ``keys`` go and the given ones of ``keys`` come.

    Given rows of other keys are an error of the caller and are not written. Null keys equal
    nothing. Tables that aren't named, and buckets without a key, keep their folders.
    """
    if head(spark, root) != expected:
        raise Conflict(f"{root} is at {head(spark, root)}, not at {expected}")
    state = _state(spark, root, expected)
    key, buckets = state["key"], state["buckets"]
    keys = keys.select(_quoted(key)).where(F.col(_quoted(key)).isNotNull()).distinct()
    touched = {str(r[0]) for r in keys.select(_bucket(_quoted(key), buckets)).distinct().collect()}  # at most `buckets` rows
    for name, new in rows.items():
        entry = state["tables"][name]
        schema = StructType.fromJson(entry["schema"])
        old = _read(spark, root, entry, touched).join(keys, key, "left_anti")
        merged = old.unionByName(new.join(keys, key, "left_semi")).select(*[F.col(_quoted(f.name)).cast(f.dataType) for f in schema])
        entry["parts"] = {b: p for b, p in entry["parts"].items() if b not in touched} | _stage(spark, root, name, merged, key, buckets)
    _publish(spark, root, expected + 1, state)
    return expected + 1


def finish_jobs(spark: SparkSession, root: str, jobs: str, outputs: Mapping[str, DataFrame], finished: DataFrame, changes: Mapping[str, Column], expected: int, revision: str = "revision") -> tuple[int, DataFrame]:
    """Replace the outputs of finished jobs and bump their rows in table ``jobs``, together.

    ``finished`` has the key and the revision that a worker started from. A job goes through
    only where the stored revision is that one; its row gets ``changes`` (expressions over the
    stored row) and the next revision. Returns the new commit and the rows of ``finished`` that
    were refused: unknown or null jobs and stale revisions. A job named twice goes through if
    one of its rows may. With nothing to change there is no commit.
    """
    from vcspark.sources.shared import save_shared

    state = _state(spark, root, expected)
    key = _quoted(state["key"])
    stored = _read(spark, root, state["tables"][jobs])
    claims = finished.select(key, _quoted(revision)).distinct()
    accepted = save_shared(stored.join(claims, [state["key"], revision], "left_semi"), "finished-jobs")
    refused = finished.join(accepted.select(key, _quoted(revision)), [state["key"], revision], "left_anti")
    if accepted.isEmpty():
        return expected, refused
    bumped = accepted.withColumns({**changes, revision: F.col(_quoted(revision)) + 1})
    return replace_keys(spark, root, {**outputs, jobs: bumped}, accepted, expected), refused
