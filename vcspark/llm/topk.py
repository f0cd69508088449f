"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector's segments of 1, 1/2, 1/4, ... of its dimensions are summed up by mean and
deviation. The distance of two vectors is at least the distance of these summaries
(Cauchy-Schwarz on each segment), and a score is (|q|^2 + |x|^2 - distance) / 2, so
every resolution bounds the score from above. Rows and queries are dealt into blocks of
like vectors; the ranges of a block's summaries bound all its scores, and only pairs of
blocks whose bound reaches a query's floor are brought together. In a pair, bounds run
coarse to fine and only the survivors' scores are computed, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vcspark.sources.shared import save_shared

SCALE = 1024
ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048
SEED_ROWS = 2048
#: Centres by which rows are placed; a table has no more than it has full blocks.
CLUSTERS = 128
BOXES_PER_PART = 1024
BOX_SEGMENTS = 8
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 128, 1 << 16
_EXACT = 2.0**53
_LONG = 2**63 - 1


def _levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine, that divide ``dim``."""
    return [s for s in (1, 2, 4, 8, 16, 32) if dim % s == 0 and s < dim]


def _summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, times the root of the segment's width, side by side."""
    parts = x.reshape(len(x), segments, -1)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(parts.shape[2])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, row by row of the two arrays of equal length."""
    if not q.size:
        return np.zeros(len(q), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(r, s)) for r, s in zip(q.tolist(), x.tolist())]
    return np.array([max(-_LONG, min(_LONG, v)) for v in big], dtype=np.int64)


def search_block(query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, row_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ``k`` best rows of the block but its own that reach its floor: (query number, row number, score), best first.

    ``floor`` is a score that ``k`` rows somewhere reach, or minus infinity. Rows are
    numbered by their place; ties go to the smaller row id, then to the earlier row.
    """
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    levels = [(_summary(q, s), _summary(x, s)) for s in _levels(q.shape[1])]
    norms = [((a * a).sum(axis=1), (b * b).sum(axis=1)) for a, b in levels]
    slack = 1e-6 + 1e-9 * ((qq.max() if len(q) else 0) + (xx.max() if len(x) else 0))
    out = []
    for at in range(0, len(q), QUERIES_AT_ONCE):
        own = slice(at, at + QUERIES_AT_ONCE)
        least = floor[own].copy()
        alive = row_ids[None, :] != query_ids[own, None]
        if not levels:
            i, j = np.nonzero(alive)
        for n, ((a, b), (aa, bb)) in enumerate(zip(levels, norms)):
            if n < 2:  # coarse: all rows at once
                upper = (qq[own, None] + xx[None, :] - np.maximum(aa[own, None] + bb[None, :] - 2 * (a[own] @ b.T), 0)) / 2
                if n == 0:
                    new = np.flatnonzero(np.isneginf(least) & (alive.sum(axis=1) >= k))
                    if len(new):  # a floor from the k rows that look best
                        best = np.argpartition(np.where(alive[new], -upper[new], np.inf), k - 1, axis=1)[:, :k]
                        scores = _scores(np.repeat(q[own][new], k, axis=0), x[best.ravel()]).reshape(-1, k)
                        least[new] = scores.min(axis=1)
                alive &= ~(upper + slack < least[:, None])
                i, j = np.nonzero(alive)
            else:
                keep = [np.zeros(0, np.int64)]
                for part in range(0, len(i), PAIRS_AT_ONCE):
                    r, c = i[part : part + PAIRS_AT_ONCE], j[part : part + PAIRS_AT_ONCE]
                    near = a[own][r] - b[c]
                    upper = (qq[own][r] + xx[c] - np.einsum("ij,ij->i", near, near)) / 2
                    keep.append(part + np.flatnonzero(~(upper + slack < least[r])))
                keep = np.concatenate(keep)
                i, j = i[keep], j[keep]
        scores = np.concatenate([np.zeros(0, np.int64), *[_scores(q[own][i[p : p + PAIRS_AT_ONCE]], x[j[p : p + PAIRS_AT_ONCE]]) for p in range(0, len(i), PAIRS_AT_ONCE)]])
        reach = scores >= least[i]
        i, j, scores = i[reach], j[reach], scores[reach]
        order = np.lexsort((j, row_ids[j], -scores, i))
        i, j, scores = i[order], j[order], scores[order]
        first = np.searchsorted(i, i)
        best = np.arange(len(i)) - first < k
        out.append((i[best] + at, j[best], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def usable_vectors(df: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each component, a row for each usable row.

    Null ids, null vectors and vectors with null or non-finite components are left
    out. Rows that repeat an id stay. An empty vector scores 0 with other empty ones.
    """
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(F.col(vector), lambda x: _floor(x.cast("double") * scale))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    return rows.withColumn("dim", F.size("v"))


def _floor(x: Column) -> Column:
    """floor that stays a double, whatever its size."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    return np.array(v.tolist(), dtype=float).reshape(len(v), dim)


def _placed(rows: DataFrame, seeds: object, clusters: int, k: int | None) -> DataFrame:
    """``rows`` with cluster (the nearest of the seed's first ``clusters`` rows), stats (squared norm and the summary at the box's resolution) and, for queries (``k``), floor."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, group in part.groupby("dim"):
                v, floor, cluster = _matrix(group.v, dim), np.full(len(group), -np.inf), np.zeros(len(group), np.int64)
                if dim in seeds.value:
                    ids, x = seeds.value[dim]
                    centres = x[:clusters]
                    cluster = ((centres * centres).sum(axis=1)[None, :] - 2 * (v @ centres.T)).argmin(axis=1)
                    if k is not None:
                        i, _, scores = search_block(group.vec_id.to_numpy(), v, floor, ids, x, k)
                        last = np.flatnonzero(np.bincount(i, minlength=len(group)) >= k)
                        floor[last] = scores[np.searchsorted(i, last, side="right") - 1]
                segments = max((s for s in _levels(dim) if s <= BOX_SEGMENTS), default=0)
                stats = np.zeros((len(group), 1 + 2 * BOX_SEGMENTS))
                stats[:, 0] = (v * v).sum(axis=1)
                if segments:
                    stats[:, 1 : 1 + 2 * segments] = _summary(v, segments)
                yield group.assign(cluster=cluster, stats=list(stats), floor=floor)

    return rows.select("vec_id", "dim", "v").mapInPandas(run, "vec_id long, dim int, v array<double>, cluster long, stats array<double>, floor double")


def _blocked(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with block, each of about ``size`` like rows of one dimension; and the blocks' boxes."""
    parts = rows.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    # at most CLUSTERS rows for each dimension
    rows = rows.join(F.broadcast(parts), ["dim", "cluster"])
    rows = save_shared(rows.withColumn("block", F.xxhash64("dim", "cluster", F.pmod(F.xxhash64("vec_id", "v"), "parts"))).drop("parts", "cluster"), f"topk-{name}-blocks")
    box = [f(F.col("stats")[i]) for i in range(1 + 2 * BOX_SEGMENTS) for f in (F.min, F.max)]
    boxes = rows.groupBy("dim", "block").agg(F.min("floor").alias("floor"), F.array(*box[::2]).alias("low"), F.array(*box[1::2]).alias("high"))
    return rows.drop("stats"), save_shared(boxes, f"topk-{name}-boxes")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows with the highest inner products.

    ``rows`` and ``queries`` are tables (vec_id, v, dim) as ``usable_vectors`` makes
    them; a row is no candidate for the query of the same id, and vectors meet only
    those of their own dimension. Rows that repeat an id are candidates each for
    itself; queries that repeat an id are one query, whose vector is the smallest
    (component by component). Fewer than ``k`` candidates: all of them. Ties go to the
    smaller id. Scores that no long holds are clamped to plus or minus 2**63 - 1.

    A floor for each query, and the centres of the blocks, come from a bounded seed
    (``SEED_ROWS`` rows, which are searched again with the rest), so the result doesn't
    depend on it. Blocks hold about ``ROWS_PER_BLOCK`` rows and ``QUERIES_PER_BLOCK``
    queries. A row travels once for each block of queries that its block's bound
    doesn't rule out.
    """
    spark = rows.sparkSession
    rows = save_shared(rows.select("vec_id", "dim", "v"), "topk-rows")
    part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))
    count = rows.count()
    clusters = max(1, min(CLUSTERS, -(-count // ROWS_PER_BLOCK)))
    fit = min(1.0, 4 * SEED_ROWS / max(1, count))
    seed = rows.where(part < int(fit * (1 << 30))).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SEED_ROWS).toPandas()
    seeds = spark.sparkContext.broadcast({d: (g.vec_id.to_numpy(), _matrix(g.v, d)) for d, g in seed.groupby("dim")})
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    left, boxes = _blocked(_placed(rows, seeds, clusters, None), ROWS_PER_BLOCK, "rows")
    right, asked = _blocked(_placed(once, seeds, clusters, k), QUERIES_PER_BLOCK, "queries")

    # the ranges of two blocks' summaries are at least this far apart, so no score is higher than the bound
    boxes = boxes.select("dim", F.col("block").alias("rb"), F.col("low").alias("rl"), F.col("high").alias("rh"))
    asked = asked.select("dim", F.col("block").alias("qb"), "floor", F.col("low").alias("ql"), F.col("high").alias("qh"))
    gap = F.aggregate(F.sequence(F.lit(1), F.lit(2 * BOX_SEGMENTS)), F.lit(0.0), lambda s, i: s + F.pow(F.greatest(F.lit(0.0), F.get("ql", i) - F.get("rh", i), F.get("rl", i) - F.get("qh", i)), F.lit(2.0)))
    norms = F.get("qh", F.lit(0)) + F.get("rh", F.lit(0))
    # the blocks' boxes, few beside their rows, meet in parts, each with all boxes of queries
    parts = max(1, -(-boxes.count() // BOXES_PER_PART))
    boxes = boxes.withColumn("part", F.pmod(F.xxhash64("rb"), F.lit(parts)))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = boxes.join(asked, ["dim", "part"]).where((norms - gap) / 2 + 1e-6 + norms * 1e-9 >= F.col("floor")).select("rb", "qb")
    met = save_shared(met, "topk-pairs")

    def search(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        dim = int(r.dim.iloc[0])
        i, j, scores = search_block(q.vec_id.to_numpy(), _matrix(q.v, dim), q.floor.to_numpy(), r.vec_id.to_numpy(), _matrix(r.v, dim), k)
        return pd.DataFrame({"query_id": q.vec_id.to_numpy()[i], "vec_id": r.vec_id.to_numpy()[j], "score": scores})

    left = left.withColumnRenamed("block", "rb").join(met, "rb").select("rb", "qb", "dim", "vec_id", "v")
    right = right.withColumnRenamed("block", "qb").join(met, "qb").select("rb", "qb", "dim", "vec_id", "v", "floor")
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
