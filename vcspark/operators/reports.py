"""Aggregate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_summary(rows: DataFrame, dimensions: list[str], cost: str) -> DataFrame:
    """Calls and cost in total and by each dimension, with g_<dimension> = 1 where it is summed over.

    One pass: rows are grouped by all dimensions first, and only these sums are grouped again.
    """
    base = rows.groupBy(*dimensions).agg(F.count("*").alias("calls"), F.sum(cost).alias("cost"))
    out = None
    for kept in [None, *dimensions]:
        names = [kept] if kept else []
        part = base.groupBy(*names).agg(F.sum("calls").alias("calls"), F.round(F.sum("cost"), 2).alias("cost"))
        part = part.where("calls is not null").select(*[F.col(x) if x == kept else F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in dimensions], *[F.lit(int(x != kept)).alias(f"g_{x}") for x in dimensions], "calls", "cost")
        out = part if out is None else out.unionByName(part)
    return out


def level_at_least(level: Column, order: list[str], least: str) -> Column:
    """Whether a level is at or above ``least`` in ``order``; a list of values, so it is pushed down."""
    return level.isin(*order[order.index(least) :])


def retained(rows: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``now``."""
    return rows.where(F.col(at) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def trailing_throughput(rows: DataFrame, at: str, now: str, minutes: int, keys: list[str]) -> DataFrame:
    end = F.lit(now).cast("timestamp")
    recent = rows.where((F.col(at) > end - F.make_interval(mins=F.lit(minutes))) & (F.col(at) <= end))
    return recent.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.count("*") / float(minutes), 4).alias("per_minute"))


def index_percentiles(rows: DataFrame, keys: list[str], value: str, tie: str, parts: dict[str, float]) -> DataFrame:
    """Per key the values at place floor(n * part) of the sorted ones (no interpolation), and the mean.

    Ranks instead of a collected list: a key of any size stays rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    placed = rows.select(*keys, value, tie).where(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(value, tie)) - 1).withColumn("__n", F.count("*").over(w))
    picks = [F.max(F.when(F.col("__i") == F.floor(F.col("__n") * p), F.col(value))).alias(name) for name, p in parts.items()]
    return placed.groupBy(*keys).agg(*picks, F.round(F.avg(value), 4).alias("mean"))


def longest_prefix_rate(rows: DataFrame, name: str, rates: DataFrame) -> DataFrame:
    """``rows`` with the rate of the longest prefix (prefix, rate) of ``name``; those without one go.

    Rates (a price list, some hundreds at most) become one map, in one broadcast row;
    a name looks up its prefixes in it, longest first. Rows neither move nor collapse.
    """
    table = rates.agg(F.map_from_entries(F.collect_list(F.struct("prefix", "rate"))).alias("__rates"))
    lengths = F.sequence(F.length(name), F.least(F.length(name), F.lit(1)), F.lit(-1))
    found = F.filter(F.transform(lengths, lambda n: F.try_element_at("__rates", F.substring(F.col(name), F.lit(1), n))), lambda r: r.isNotNull())
    return rows.join(F.broadcast(table)).withColumn("rate", F.get(found, F.lit(0))).drop("__rates").where("rate is not null")
