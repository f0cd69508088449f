"""Copies of tables into another place, counted on the way and again where they arrived."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType

COMPARED = "table_name string, column_name string, source_n long, target_n long, source_least long, target_least long, source_most long, target_most long, same boolean"


def _hashable(column: Column, kind: DataType) -> Column:
    if isinstance(kind, MapType):
        return F.array_sort(F.map_entries(column))
    return F.to_json(column) if isinstance(kind, VariantType) else column


def _measures(df: DataFrame, vectors: list[str]) -> list[Column]:
    """Rows, a digest that no order of rows changes, and for each vector column the number and the least and greatest length of those that aren't null."""
    parts = []
    for f in df.schema:
        value = F.col("`" + f.name.replace("`", "``") + "`")
        parts += [_hashable(value, f.dataType), value.isNull()]
    out = [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*parts).cast("decimal(20,0)")).cast("string").alias("digest")]
    for i, name in enumerate(vectors):
        value = F.col("`" + name.replace("`", "``") + "`")
        size = F.when(value.isNotNull(), F.size(value).cast("long"))
        out += [F.count(size).alias(f"n{i}"), F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}")]
    return out


def compare_copy(spark: SparkSession, name: str, source: Mapping, target: DataFrame, vectors: list[str]) -> list[tuple]:
    """One row for the table and one for each vector column: what the source had, what the target has, whether they agree."""
    got = target.agg(*_measures(target, vectors)).first().asDict()
    rows = [(name, None, source["rows"], got["rows"], None, None, None, None, source["rows"] == got["rows"] and source["digest"] == got["digest"])]
    for i, column in enumerate(vectors):
        pairs = [(source[k], got[k]) for k in (f"n{i}", f"lo{i}", f"hi{i}")]
        rows.append((name, column, *[v for pair in pairs for v in pair], all(a == b for a, b in pairs)))
    return rows


def measure(df: DataFrame, vectors: list[str]) -> dict:
    """What ``compare_copy`` takes as the source, from a pass of its own."""
    return df.agg(*_measures(df, vectors)).first().asDict()


def copy_tables(spark: SparkSession, tables: Mapping[str, DataFrame], target: str, vectors: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Copy tables to ``target``/<name> and return the comparison.

    Nothing is copied where one of the places exists already: rows are neither doubled nor
    overwritten. The source is counted in the pass that writes it, so the figures are those of
    the rows that were sent, also where the source changes meanwhile. A copy that differs is
    reported, not mended. Columns of any name; tables without rows have null lengths.
    """
    vectors = vectors or {}
    taken = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
        if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            taken.append(name)
    if taken:
        raise ValueError(f"the target has these tables already: {', '.join(sorted(taken))}")
    rows = []
    for name, df in tables.items():
        seen, columns = Observation(), list(vectors.get(name, ()))
        df.observe(seen, *_measures(df, columns)).write.parquet(f"{target}/{name}")
        rows += compare_copy(spark, name, seen.get, spark.read.schema(df.schema).parquet(f"{target}/{name}"), columns)
    return spark.createDataFrame(rows, COMPARED)
