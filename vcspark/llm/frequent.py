"""The most frequent keys of a count table, as a table of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counted: DataFrame, limit: int, count: str = "count") -> DataFrame:
    """The rows of ``counted`` with the largest counts, at most ``limit``: all from some count on.

    ``counted`` should be a saved table. Counts are told apart by sixteenths of a power
    of two, whose histogram (a thousand rows at most) is all that reaches the driver,
    whatever the number of rows or tasks. Where one level alone holds more than
    ``limit`` rows, it and those below are left out.
    """
    level = F.floor(F.log2(count) * 16)
    least, total = None, 0
    for row in counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        total += row.n
        if total > limit:
            break
        least = row.level
    return counted.where(F.lit(False) if least is None else level >= least)
