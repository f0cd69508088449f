"""The best products of many queries by the cosine of their vectors: blocks of both sides meet, a task multiplies two of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vcspark.sources.shared import save_shared

#: Rows of a block of products and of queries, rows that are multiplied at once, pairs that are summed at once.
PRODUCT_BLOCK, QUERY_BLOCK, CHUNK, QUERY_CHUNK, EXACT_PAIRS = 16_384, 8_192, 4_096, 1_024, 65_536
#: Groups that categories are dealt to; a task takes the categories of a group one by one.
CATEGORY_GROUPS = 512
#: Scores nearer than this to the middle of a rounding step count as either neighbour.
_HALF = 1e-6


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """The rows' vectors, all of one length and without nulls, as doubles."""
    values = pa.concat_arrays([c.flatten() for c in column.chunks]) if rows else pa.array([], pa.float64())
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1 if len(values) else 0)


def lengths(v: np.ndarray, hollow: np.ndarray) -> np.ndarray:
    """Euclidean lengths, the squares summed from first to last, as an aggregate over an array does; -1 for vectors that held nulls."""
    with np.errstate(all="ignore"):
        return np.where(hollow, -1.0, np.sqrt(_sums(v * v)))


def _sums(products: np.ndarray) -> np.ndarray:
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def unit(v: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Vectors of length 1; zero stays zero, those that can't be scaled in doubles are NaN and have to be looked at one by one."""
    fine = np.isfinite(length) & (length > 1e-140) & (length < 1e140)
    out = np.divide(v, length[:, None], out=np.zeros_like(v), where=fine[:, None])
    out[~fine & ~(length <= 0)] = np.nan
    return out


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The cosines of the pairs (i, j), summed from first to last; 0 where a length is or a vector held nulls."""
    out = np.zeros(len(i))
    for at in range(0, len(i), EXACT_PAIRS):
        x, y = i[at : at + EXACT_PAIRS], j[at : at + EXACT_PAIRS]
        with np.errstate(all="ignore"):
            under = np.where((la[x] < 0) | (lb[y] < 0), 0.0, la[x] * lb[y])
            out[at : at + EXACT_PAIRS] = np.where(under == 0, 0.0, _sums(a[x] * b[y]) / under)
    return out


def few_copies(v: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows, given in order of preference, that are among the first ``k`` of their vector."""
    rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel()
    _, kind = np.unique(rows, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    return np.sort(order[first_of_each([kind[order]], k)])


def first_of_each(groups: list[np.ndarray], k: int) -> np.ndarray:
    """Whether each row is among the first ``k`` of its group; rows of equal values in ``groups`` lie together."""
    rows = len(groups[0])
    if not rows:
        return np.zeros(0, bool)
    start = np.flatnonzero(np.r_[True, np.any([g[1:] != g[:-1] for g in groups], axis=0)])
    return np.arange(rows) - np.repeat(start, np.diff(np.r_[start, rows])) < k


def _best(query: np.ndarray, item: np.ndarray, visual: np.ndarray, k: int, weight: float, base: float, digits: int) -> np.ndarray:
    """Numbers of the pairs that may be among the ``k`` best of their query by rounded score and smaller item.

    A score close to the middle of a rounding step enters with the lower value and stays
    in any case, each such value with its first ``k`` items, NaN likewise.
    """
    with np.errstate(invalid="ignore"):
        scaled = (weight * visual + base) * 10.0**digits
        low, high = np.floor(scaled + 0.5 - _HALF), np.floor(scaled + 0.5 + _HALF)
    order = np.lexsort((item, np.where(np.isnan(low), np.inf, -low), query))
    kept = order[first_of_each([query[order]], k)]
    odd = np.flatnonzero(~(low == high))
    if len(odd):
        value = np.nan_to_num(visual[odd], nan=9.0)
        odd = odd[np.lexsort((item[odd], value, query[odd]))]
        kept = np.union1d(kept, odd[first_of_each([query[odd], np.nan_to_num(visual[odd], nan=9.0)], k)])
    return kept


def nearest(queries: DataFrame, products: DataFrame, k: int, weight: float, base: float, least: float, digits: int) -> DataFrame:
    """(query_id, product_id, visual): pairs of one vector length and compatible category, among them all of each query's ``k`` best.

    ``queries`` (query_id, vector, category), ``products`` (product_id, vector, category);
    a null category fits all. ``visual`` is the cosine, at least 0, summed as Spark sums
    arrays. The rounded score ``weight * visual + base`` ranks, the smaller product_id
    first among equals; pairs whose score is clearly below ``least`` may be missing. All
    pairs of blocks are multiplied; of the copies of a vector in a block the first ``k`` count.
    """
    slack = 2.0 / 10**digits / weight
    floor = (least - base) / weight - slack
    kind = lambda n: F.struct(F.lit(n).alias("kind"), F.lit(0).alias("group"))
    own = F.struct(F.lit("same").alias("kind"), F.pmod(F.xxhash64("category"), F.lit(CATEGORY_GROUPS)).cast("int").alias("group"))

    def side(t: DataFrame, name: str, free: Column, bound: Column) -> DataFrame:
        """Rows under each kind of meeting that they take part in; a pair meets in exactly one."""
        hollow = F.exists("vector", lambda y: y.isNull())
        clean = F.when(hollow, F.transform("vector", lambda x: F.lit(0.0))).otherwise(F.transform("vector", lambda x: x.cast("double")))
        rows = t.where("vector is not null").select(F.col(name), F.size("vector").alias("dim"), clean.alias("v"), hollow.alias("hollow"), F.col("category").cast("string").alias("category"))
        return rows.withColumn("meets", F.explode(F.when(F.col("category").isNull(), free).otherwise(bound))).select(name, "dim", "v", "hollow", "category", "meets.*")

    p = side(products, "product_id", F.array(kind("any query")), F.array(kind("free query"), own))
    q = side(queries, "query_id", F.array(kind("any query"), kind("free query")), F.array(kind("any query"), own))
    keys = ["dim", "kind", "group"]
    count = lambda t, n, size: t.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(n))
    sizes = save_shared(count(p, "np", PRODUCT_BLOCK).join(count(q, "nq", QUERY_BLOCK), keys), "nearest-blocks")
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(F.broadcast(sizes), keys).withColumn("bp", number("product_id", "np")).withColumn("bq", every("nq")).drop("np", "nq")
    q = q.join(F.broadcast(sizes), keys).withColumn("bq", number("query_id", "nq")).withColumn("bp", every("np")).drop("np", "nq")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("product_id", products.schema["product_id"].dataType), T.StructField("visual", T.DoubleType())])

    def search(pv: np.ndarray, ph: np.ndarray, qv: np.ndarray, qh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, product, visual) of two blocks; products in the order of their ids."""
        rows = few_copies(np.column_stack([pv, ph]), k)
        pv = pv[rows]
        pl, ql = lengths(pv, ph[rows]), lengths(qv, qh)
        pu, qu = unit(pv, pl), unit(qv, ql)
        found = []
        for a in range(0, len(qv), QUERY_CHUNK):
            least_of = np.full(len(qv[a : a + QUERY_CHUNK]), floor)
            have = (np.array([], int), np.array([], int), np.array([]))
            for b in range(0, len(pv), CHUNK):
                near = qu[a : a + QUERY_CHUNK] @ pu[b : b + CHUNK].T
                strange = np.isnan(near)
                if near.shape[1] > k:
                    kth = np.partition(np.where(strange, -2.0, near), -k, axis=1)[:, -k]
                    least_of = np.maximum(least_of, np.maximum(kth, 0.0) - slack)
                # below 0 all cosines count as 0, so none of them is worse than another
                i, j = np.nonzero(strange | (near >= np.where(least_of > 0, least_of, -2.0)[:, None]))
                c = cosines(qv, pv, i + a, j + b, ql, pl)
                have = tuple(np.concatenate(x) for x in zip(have, (i + a, j + b, np.where(c < 0, 0.0, c))))
                kept = _best(*have, k, weight, base, digits)
                have = tuple(x[kept] for x in have)
            found.append(have)
        i, j, c = (np.concatenate(x) for x in zip(*found))
        return i, rows[j], c

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        x = x.take(pc.sort_indices(x, [("product_id", "ascending")])) if len(x) and len(y) else x
        px, qy, out = x.column("category").to_pylist(), y.column("category").to_pylist(), []
        same = len(x) > 0 and x.column("kind")[0].as_py() == "same"
        of_p, of_q = {}, {}
        for rows, names in ((of_p, px), (of_q, qy)):
            for n, name in enumerate(names):
                rows.setdefault(name if same else None, []).append(n)
        for name in of_p.keys() & of_q.keys():
            a, b = x.take(of_p[name]), y.take(of_q[name])
            held = [(matrix(t.column("v"), len(t)), t.column("hollow").to_numpy()) for t in (a, b)]
            i, j, c = search(*held[0], *held[1])
            out.append(pa.table([b.column("query_id").take(i), a.column("product_id").take(j), pa.array(c)], names=["query_id", "product_id", "visual"]))
        return pa.concat_tables(out) if out else pa.table([y.column("query_id").slice(0, 0), x.column("product_id").slice(0, 0), pa.array([], pa.float64())], names=["query_id", "product_id", "visual"])

    blocks = [*keys, "bp", "bq"]
    return p.groupBy(*blocks).cogroup(q.groupBy(*blocks)).applyInArrow(meet, schema)
