"""Queries on pixels. The tables hold no pictures; the vectors' components, as levels, make up 16 x 16 pixels each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.functions import geometry, pictures
from vcspark.functions.hashing import hamming
from vcspark.plans.registry import query, table

SIDE = 16


def pixels(vector: Column | str, shift: int = 0) -> Column:
    """Component ``(column + 3 * row + 5 * channel + shift) mod size`` as a byte; null for a null or empty vector."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def level(i: Column) -> Column:
        place = F.floor(i / 3)
        x = F.get(v, ((place % SIDE + F.floor(place / SIDE) * 3 + i % 3 * 5 + shift) % F.size(v)).cast("int"))
        return F.lpad(F.hex(F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) + 1) * 127.5).cast("int")), 2, "0")

    return F.when(F.size(v) > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3 * SIDE * SIDE - 1)), level), "")))


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", pixels("embedding").alias("rgb"), pixels("embedding", 1).alias("next_rgb"), F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"))


@query()
def picture_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Both hashes of each picture, hash and sharpness of the part inside a box, and the difference from the picture moved by one column."""
    k = F.col("vec_id")
    rows = _pictures(spark, d).withColumn("box", geometry.box(k % 5 / 10.0, k % 3 / 10.0, (k % 7 + 1) / 10.0, (k % 4 + 1) / 5.0))
    whole = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    hashed = rows.select(
        "vec_id", pictures.difference_hash("rgb", "w", "h").alias("dhash"), pictures.average_hash("rgb", "w", "h").alias("ahash"), pictures.region_hash("rgb", "w", "h", "box").alias("box_hash"),
        pictures.region_sharpness("rgb", "w", "h", "box").alias("box_sharpness"), pictures.region_sharpness("rgb", "w", "h", whole).alias("sharpness"),
        pictures.picture_difference("rgb", "w", "h", "next_rgb", "w", "h").alias("moved"), pictures.average_hash("next_rgb", "w", "h").alias("next_hash"),
    )
    return hashed.withColumn("moved_bits", hamming("ahash", "next_hash")).drop("next_hash")


@query()
def picture_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The 64 dimensions of each picture."""
    return _pictures(spark, d).select("vec_id", pictures.picture_embedding("rgb", "w", "h").alias("vector"))
