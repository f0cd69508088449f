"""Duplicate products at several levels of evidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vcspark.functions.hashing import bands, hex_half
from vcspark.functions.taxonomy import identity_key
from vcspark.operators.nearest import matrix
from vcspark.operators.skew import salted_join
from vcspark.sources.shared import save_shared

# Levels from strong to weak, largest hash distance, least vector similarity.
LEVELS = ["source_product_id", "canonical_url", "exact_image_hash", "sku_gtin", "perceptual_hash", "embedding", "brand_title_color"]
HASH_DISTANCE, VECTOR_SIMILARITY = 6, 0.96
#: Rows of a block of vectors, at least and at most, blocks that a table is cut into between them, rows of two blocks that are multiplied at once.
VECTOR_BLOCK, MOST_VECTORS, VECTOR_BLOCKS, VECTOR_CHUNK = 4096, 131_072, 8, 2048


def near_hash_pairs(left: DataFrame, right: DataFrame, distance: int = HASH_DISTANCE) -> DataFrame:
    """(left_id, right_id, distance) of hashes (id, hash) within ``distance`` bits, exactly.

    Within that distance, one of distance + 1 blocks is equal, so blocks are joined
    and the candidates counted; each pair comes once, from its first common block.
    """
    halves = lambda n: [hex_half("hash", i).alias(f"{n}_{i}") for i in (1, 9)]
    side = lambda t, n: t.where(F.length("hash") == 16).select(F.col("id").alias(f"{n}_id"), *halves(n), bands("hash", distance).alias(f"{n}_bands")).withColumn("band", F.explode(f"{n}_bands"))
    apart = F.bit_count(F.col("left_1").bitwiseXOR(F.col("right_1"))) + F.bit_count(F.col("left_9").bitwiseXOR(F.col("right_9")))
    met = side(left, "left").join(side(right, "right"), "band").withColumn("distance", apart).where(F.col("distance") <= distance)
    first = F.get(F.filter(F.zip_with("left_bands", "right_bands", lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()), F.lit(0))
    return met.where(F.col("band") == first).select("left_id", "right_id", "distance")


def hash_classes(rows: DataFrame) -> DataFrame:
    """(hash, rep, copies) of hashes (id, hash): each distinct hash with its smallest id and its number of ids."""
    return rows.where(F.length("hash") == 16).groupBy("hash").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))


def near_hash_groups(rows: DataFrame, distance: int = HASH_DISTANCE) -> DataFrame:
    """(left_id, right_id, distance) from which all pairs within ``distance`` bits follow, of hashes (id, hash) with one hash for each id.

    A class is the ids of one hash, its representative the smallest. Rows at distance 0
    are membership: the representative and each other id of the class. The others are
    pairs of representatives, the smaller id first. Two ids are near if they are in one
    class or their classes' representatives are a pair; the rows grow with the ids and
    the pairs of distinct hashes, not with the square of a class.
    """
    classes = save_shared(hash_classes(rows), "hash-classes")
    distinct = classes.select(F.col("rep").alias("id"), "hash")
    pairs = near_hash_pairs(distinct, distinct, distance).where("left_id < right_id")
    shared = classes.where("copies > 1").select("hash", "rep", "copies")
    members = salted_join(rows.select("id", "hash").distinct(), shared, ["hash"], "copies", "id", "inner").where("id <> rep")
    return members.select(F.col("rep").alias("left_id"), F.col("id").alias("right_id"), F.lit(0).alias("distance")).unionByName(pairs)


def near_vector_pairs(left: DataFrame, right: DataFrame, least: float = VECTOR_SIMILARITY) -> DataFrame:
    """(left_id, right_id, similarity) of vectors (id, v) of one length whose cosine is at least ``least``, exactly.

    Two unit vectors that close differ in their angle to any third by no more than the
    angle of ``least``; so vectors are dealt by the angle to two fixed directions, in
    steps of that angle, and meet only those of the same and the neighbouring steps.
    Those of one step meet in blocks, which grow with the table from ``VECTOR_BLOCK`` to
    ``MOST_VECTORS`` rows, so that a row is sent to about ``VECTOR_BLOCKS`` others however
    many rows there are up to a million; a task multiplies two blocks piece by piece and
    returns the pairs found. Null and zero vectors have none.
    """
    step = float(np.arccos(least))

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, group in part.groupby("dim"):
                v = np.array(group.v.tolist(), dtype=float).reshape(len(group), dim)
                length = np.sqrt((v * v).sum(axis=1))
                good = np.isfinite(length) & (length > 0)
                v = v[good] / length[good, None]
                axes = np.stack([np.ones(dim), np.where(np.arange(dim) % 2, -1.0, 1.0)]) / np.sqrt(dim)
                steps = np.floor(np.arccos(np.clip(v @ axes.T, -1, 1)) / step).astype(int)
                yield pd.DataFrame({"id": group.id[good], "dim": dim, "v": list(v), "s0": steps[:, 0], "s1": steps[:, 1]})

    def side(t: DataFrame) -> DataFrame:
        rows = t.where("v is not null and size(v) > 0 and not exists(v, x -> x is null)").select("id", F.size("v").alias("dim"), F.transform("v", lambda x: x.cast("double")).alias("v"))
        rows = rows.mapInPandas(placed, "id long, dim int, v array<double>, s0 int, s1 int")
        return save_shared(rows, "vector-steps")

    def blocks(t: DataFrame, n: str, block: int) -> DataFrame:
        return t.groupBy("dim", "s0", "s1").agg(F.ceil(F.count("*") / block).cast("int").alias(n))

    same = left is right
    a = side(left)
    b = a.sparkSession.read.schema(a.schema).parquet(a._shared_path) if same else side(right)
    block = lambda t: min(max(VECTOR_BLOCK, -(-t.count() // VECTOR_BLOCKS)), MOST_VECTORS)
    of_a, of_b = block(a), block(b)
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    # the right side's rows go to the steps around their own, if the left side has such a step
    b = b.withColumn("d0", near).withColumn("d1", near).withColumn("s0", F.col("s0") + F.col("d0")).withColumn("s1", F.col("s1") + F.col("d1")).drop("d0", "d1")
    sizes = save_shared(blocks(a, "na", of_a).join(blocks(b, "nb", of_b), ["dim", "s0", "s1"]), "vector-blocks")
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["dim", "s0", "s1", "ba", "bb"]
    a = a.join(sizes, ["dim", "s0", "s1"]).withColumn("ba", number("na")).withColumn("bb", every("nb")).select(*keys, "id", "v")
    b = b.join(sizes, ["dim", "s0", "s1"]).withColumn("bb", number("nb")).withColumn("ba", every("na")).select(*keys, "id", "v")

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        if len(x) and len(y):
            v, w = matrix(x.column("v"), len(x)), matrix(y.column("v"), len(y))
            for i in range(0, len(v), VECTOR_CHUNK):
                for j in range(0, len(w), VECTOR_CHUNK):
                    cosine = v[i : i + VECTOR_CHUNK] @ w[j : j + VECTOR_CHUNK].T
                    at = np.flatnonzero(cosine >= least)
                    r, c = np.divmod(at, cosine.shape[1])
                    for held, part in zip(found, (r + i, c + j, cosine.ravel()[at])):
                        held.append(part)
        r, c, cosine = map(np.concatenate, found)
        return pa.table([x.column("id").take(r), y.column("id").take(c), pa.array(cosine)], names=["left_id", "right_id", "similarity"])

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(multiply, "left_id long, right_id long, similarity double")


def _choices(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``rows`` (keys, shop, id), at most three for a key: the smallest id without a shop, and those of the two shops whose smallest ids are smallest.

    Among them is the smallest id that is not of one given shop, whichever it is.
    """
    least = rows.groupBy(*keys, "shop").agg(F.min("id").alias("id"))
    order = Window.partitionBy(*keys, F.col("shop").isNull()).orderBy("id", "shop")
    return least.withColumn("__r", F.row_number().over(order)).where("__r <= 2").drop("__r")


def find_duplicates(candidates: DataFrame, catalogue: DataFrame, exact_only: bool = False) -> DataFrame:
    """(candidate_id, product_id, level): the strongest level at which each candidate has a product.

    Both have id, source, source_product_id, canonical_url, image_sha256, sku, gtin,
    brand, title, color, perceptual_hash, and may have embedding. Of equal levels the
    smallest product id counts, and candidates without a product don't appear. Null keys
    match nothing. From the perceptual hash on, a product of the candidate's shop is
    another product: the shop's number, sku and gtin have been compared before, and only
    candidates that no stronger level has settled go on.

    No level makes the pairs of a key: a key, hash or vector brings at most three
    products, and near ones are found among distinct hashes and vectors.
    """
    col = F.col
    shop = F.when(col("source_product_id").isNotNull(), col("source")).alias("shop")

    def exact(number: int, *names: str) -> DataFrame:
        smallest = catalogue.groupBy(*names).agg(F.min("id").alias("product_id"))
        return candidates.select(col("id").alias("candidate_id"), *names).join(smallest, list(names)).select("candidate_id", F.lit(number).alias("n"), "product_id")

    def strongest(found: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, found).groupBy("candidate_id").agg(F.min(F.struct("n", "product_id")).alias("b"))

    def chosen(number: int, rows: DataFrame, choices: DataFrame, key: str) -> DataFrame:
        """The smallest product under the candidates' (id, shop, key) that isn't of their shop."""
        choices = choices.select(key, col("shop").alias("p_shop"), col("id").alias("product_id"))
        met = rows.join(choices, key).where(~F.coalesce(col("shop") == col("p_shop"), F.lit(False)))
        return met.groupBy(col("id").alias("candidate_id")).agg(F.min("product_id").alias("product_id")).select("candidate_id", F.lit(number).alias("n"), "product_id")

    found = [exact(0, "source", "source_product_id"), exact(1, "canonical_url"), exact(2, "image_sha256"), exact(3, "sku"), exact(3, "gtin")]
    if not exact_only:
        found = [save_shared(strongest(found).select("candidate_id", "b.*"), "dedup-exact")]
        left = candidates.join(found[0], col("id") == col("candidate_id"), "left_anti")
        rows = left.select("id", shop, col("perceptual_hash").alias("hash")).where(F.length("hash") == 16)
        choices = save_shared(_choices(catalogue.select("id", shop, col("perceptual_hash").alias("hash")).where(F.length("hash") == 16), ["hash"]), "dedup-hashes")
        asked, held = (t.select(col("hash").alias("id"), "hash").distinct() for t in (rows, choices))
        near = near_hash_pairs(asked, held).select(col("left_id").alias("asked"), col("right_id").alias("hash")).join(choices, "hash")
        near = _choices(near.select(col("asked").alias("hash"), "shop", "id"), ["hash"])
        found.append(save_shared(chosen(4, rows, near, "hash"), "dedup-near"))
        left = left.join(found[1], col("id") == col("candidate_id"), "left_anti")
        if "embedding" in candidates.columns and "embedding" in catalogue.columns:
            rows = left.where("embedding is not null").select("id", shop, col("embedding").alias("v"))
            choices = save_shared(_choices(catalogue.where("embedding is not null").select("id", shop, col("embedding").alias("v")), ["v"]), "dedup-vectors")
            asked, held = (save_shared(t.groupBy("v").agg(F.min("id").alias("id")), "dedup-distinct") for t in (rows, choices))
            alike = near_vector_pairs(asked, held).select("left_id", "right_id")
            near = alike.join(held.select(col("id").alias("right_id"), "v"), "right_id").join(choices, "v").select("left_id", "shop", "id")
            rows = rows.join(asked.select("v", col("id").alias("left_id")), "v").select("id", "shop", "left_id")
            found.append(save_shared(chosen(5, rows, _choices(near, ["left_id"]), "left_id"), "dedup-alike"))
            left = left.join(found[2], col("id") == col("candidate_id"), "left_anti")
        named = identity_key("brand", "title", "color").alias("key")
        found.append(chosen(6, left.select("id", shop, named), _choices(catalogue.select("id", shop, named).where("key is not null"), ["key"]), "key"))
    best = strongest(found)
    return best.select("candidate_id", col("b.product_id").alias("product_id"), F.array(*map(F.lit, LEVELS))[col("b.n")].alias("level"))


def content_hash(*fields: Column) -> Column:
    """SHA-256 over the fields that make up a product's content, taxonomy included; null differs from empty."""
    return F.sha2(F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}), 256)


def ingest_outcome(existing_hash: Column, new_hash: Column, existing_source: Column, source: Column) -> Column:
    """new, duplicate (another source's product), unchanged or changed."""
    return F.when(existing_source.isNull(), "new").when(existing_source != source, "duplicate").when(existing_hash.eqNullSafe(new_hash), "unchanged").otherwise("changed")
