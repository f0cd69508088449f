"""The best products of many queries by picture, words and attributes: blocks of both sides meet, a task scores the pairs that fit."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vcspark.functions.taxonomy import UNISEX
from vcspark.functions.vectors import norm
from vcspark.operators.nearest import cosines, first_of_each, unit
from vcspark.operators.overlap import word_counts

#: Rows of a block of products (between these two) and of queries, pairs that are scored at once, words looked for in titles that are kept.
PRODUCT_BLOCK, LEAST_BLOCK, QUERY_BLOCK, PAIRS, NEEDLES = 16_384, 1_024, 8_192, 1 << 19, 256
STAGES = ["exact_hash", "perceptual_hash", "embedding"]
_CHECKS = ("category", "brand", "color", "type", "material", "pattern")


def _codes(*columns: pa.ChunkedArray | pa.Array) -> tuple[list[np.ndarray], list[str]]:
    """Each column's values as numbers of one list of names, -1 for null, and the list."""
    parts = [c for column in columns for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    names = pc.unique(pa.chunked_array(parts, columns[0].type)).drop_null()
    return [pc.index_in(c, value_set=names).fill_null(-1).to_numpy() for c in columns], names.to_pylist()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Number of items of each row, none for null, and all items."""
    a = column.combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    return a.value_lengths().fill_null(0).to_numpy(), a.flatten()


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... ``n[0]`` of them, then those from start[1] on, and so on."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(n)]


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` from 0 on to so many digits as Spark rounds: by the shortest decimal text of the number, halves up."""
    with np.errstate(invalid="ignore"):
        scaled = x * 10.0**digits
        out = np.floor(scaled + 0.5) / 10.0**digits
        odd = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(odd):
        values, of = np.unique(x[odd], return_inverse=True)
        step = Decimal(1).scaleb(-digits)
        out[odd] = np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) for v in values.tolist()])[of]
    return out


class _Vectors:
    """A block's vectors of one column: their dimensions (-1: none), lengths, and matrices of those of one dimension."""

    def __init__(self, column: pa.ChunkedArray, length: pa.ChunkedArray) -> None:
        n, flat = _lists(column)
        self.dim = np.where(column.is_null().to_numpy(), -1, n)
        self.length = length.fill_null(-1.0).to_numpy()  # vectors that hold nulls have no length
        self._values, self._start, self._held = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), _starts(n), (None, None, None)

    def of(self, dim: int) -> np.ndarray:
        """The rows as doubles; those of other dimensions are zero."""
        if self._held[0] != dim:
            rows = np.flatnonzero(self.dim == dim)
            out = np.zeros((len(self.dim), dim))
            out[rows] = self._values[self._start[rows][:, None] + np.arange(dim)]
            self._held = (dim, out, unit(out, np.where(self.dim == dim, self.length, 0.0)).astype(np.float32))
        return self._held[1]

    def scaled(self, dim: int, rows: np.ndarray) -> np.ndarray:
        """These rows with length 1, zero where the dimension is another or there is no length."""
        self.of(dim)
        return self._held[2][rows]


class _Equal:
    """Which products of a block have a picture file that a query has, or a perceptual hash within ``reach`` bits of its."""

    def __init__(self, x: pa.Table, y: pa.Table, reach: int) -> None:
        n, flat = _lists(x.column("shas"))
        (sha, self.q_sha), names = _codes(flat, y.column("image_sha256"))
        self.sha, self.sha_row, self.n_sha = sha, np.repeat(np.arange(len(n)), n), len(names)
        (p, self.p_hash), (q, self.q_hash) = (self._hashes(t) for t in (x, y))
        met = [(np.array([], int),) * 3]
        for at in range(0, len(q), step := max(1, PAIRS // max(len(p), 1))):
            part = q[at : at + step]
            apart = np.bitwise_count(part[:, None, 0] ^ p[None, :, 0])
            i, j = np.nonzero((apart <= reach) & (part[:, None, 1] == p[None, :, 1]))
            met.append((i + at, j, apart[i, j].astype(int)))
        near, self.near, self.apart = (np.concatenate(c) for c in zip(*met))
        self.n_near, self.n_hash = np.bincount(near, minlength=len(q)), len(p)

    @staticmethod
    def _hashes(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes (bits, digits), and each row's number among them, -1 without one."""
        digits = t.column("digits").fill_null(0).to_numpy()
        bits = (t.column("h1").to_numpy().astype(np.uint64) << np.uint64(32)) | t.column("h9").to_numpy().astype(np.uint64)
        rows = np.flatnonzero(digits > 0)
        values, of = np.unique(np.stack([bits[rows], digits[rows].astype(np.uint64)], 1), axis=0, return_inverse=True)
        out = np.full(len(digits), -1)
        out[rows] = of.ravel()
        return values, out

    def among(self, rows: np.ndarray) -> None:
        """Look only at these products from now on."""
        self.n_rows = len(rows)
        place = np.full(len(self.p_hash), -1)
        place[rows] = np.arange(len(rows))
        known = (place[self.sha_row] >= 0) & (self.sha >= 0)
        code, row = self.sha[known], place[self.sha_row][known]
        self.by_sha = row[np.argsort(code, kind="stable")], np.bincount(code, minlength=self.n_sha)
        code = self.p_hash[rows]
        self.by_hash = np.argsort(code, kind="stable")[(code < 0).sum() :], np.bincount(code[code >= 0], minlength=self.n_hash)

    def pairs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query * products + product, score, stage) by number, sorted, for numbers within ``queries`` and the rows of ``among``."""
        i = np.flatnonzero(self.q_sha[queries] >= 0)
        row, n = self.by_sha
        code = self.q_sha[queries[i]]
        same = np.repeat(i, n[code]) * self.n_rows + row[_spread(_starts(n)[code], n[code])]
        i = np.flatnonzero(self.q_hash[queries] >= 0)
        code = self.q_hash[queries[i]]
        met = _spread(_starts(self.n_near)[code], self.n_near[code])
        i, code, apart = np.repeat(i, self.n_near[code]), self.near[met], self.apart[met]
        row, n = self.by_hash
        near = np.repeat(i, n[code]) * self.n_rows + row[_spread(_starts(n)[code], n[code])]
        key, at = np.unique(np.r_[same, near], return_index=True)  # the first of equal ones, so equal files come first
        score = np.r_[np.ones(len(same)), 1 - np.repeat(apart, n[code]) / 64]
        return key, score[at], (at >= len(same)).astype(np.int8)


class _Aspects:
    """What of the words and attributes a block's pairs compare; queries that ask the same share an aspect."""

    def __init__(self, x: pa.Table, y: pa.Table) -> None:
        n, flat = _lists(y.column("words"))
        (asked, held), self.words = _codes(flat, _lists(x.column("words"))[1])
        self.asked, self.asked_from, self.n_asked = asked, _starts(n), n
        n, _ = _lists(x.column("words"))
        row, known = np.repeat(np.arange(len(n)), n), np.isin(held, asked)
        self.held, self.held_n = held[known], np.bincount(row[known], minlength=len(n))
        (self.p_color, self.q_color, self.colors), _ = _codes(x.column("color"), y.column("color"), _lists(x.column("colors"))[1])
        self.color_row = np.repeat(np.arange(x.num_rows), _lists(x.column("colors"))[0])
        self.stated = {c: _codes(x.column(c), y.column(c))[0] for c in ("material", "pattern")}
        (self.hay,), hays = _codes(x.column("hay"))
        self.hays, self.found = pa.array(hays, x.column("hay").type), {}
        self.types = y.column("type").to_pylist()
        self.asks = {c: y.column(f"asks_{c}").to_numpy() for c in _CHECKS}
        self.brands = _codes(x.column("brand"), y.column("brand"))[0]
        joined = [_codes(pc.binary_join(y.column(c), " "))[0][0] for c in ("words", "type")]
        parts = np.stack([*joined, self.q_color, self.brands[1], *(q for _, q in self.stated.values()), *self.asks.values()], 1).astype(np.int64)
        _, self.first, of = np.unique(parts, axis=0, return_index=True, return_inverse=True)
        self.of = of.ravel()

    def among(self, rows: np.ndarray) -> None:
        """Look only at these products from now on."""
        self.rows = rows
        self.row_n = self.held_n[rows]
        self.row_words = self.held[_spread(_starts(self.held_n)[rows], self.row_n)]

    def overlaps(self, queries: np.ndarray) -> np.ndarray:
        """Share of each query's words that each product holds; 0 for queries without words."""
        n = self.n_asked[queries]
        words = self.asked[_spread(self.asked_from[queries], n)]
        item = np.repeat(np.arange(len(queries)), n)[np.argsort(words, kind="stable")]
        first = _starts(np.bincount(words, minlength=len(self.words)))
        counts = word_counts(np.repeat(np.arange(len(self.rows)), self.row_n), self.row_words, len(self.rows), item, first, len(queries))
        return np.ascontiguousarray(counts.T) / np.maximum(n, 1)[:, None]

    def _typed(self, words: list[str]) -> np.ndarray:
        """Whether a product's titles hold one of the words, anywhere."""
        out = np.zeros(len(self.hays), bool)
        for word in words:
            if word not in self.found:
                if len(self.found) >= NEEDLES:
                    self.found.clear()
                self.found[word] = pc.match_substring(self.hays, word).to_numpy(zero_copy_only=False)
            out |= self.found[word]
        return out[self.hay[self.rows]]

    def attributes(self, queries: np.ndarray) -> np.ndarray:
        """Share of a query's checks that hold, of those that apply; 0.5 if none does. Products of other categories are gone before."""
        out = np.empty((len(queries), len(self.rows)))
        for n, q in enumerate(queries.tolist()):
            asks = {c: self.asks[c][q] for c in _CHECKS}
            applies, holds = sum(int(asks[c]) for c in ("category", "brand", "color", "type")), np.full(len(self.rows), int(asks["category"]))
            if asks["brand"]:
                holds += self.brands[0][self.rows] == self.brands[1][q]
            if asks["color"]:
                same = self.p_color == self.q_color[q]
                if self.q_color[q] >= 0:
                    same[self.color_row[self.colors == self.q_color[q]]] = True
                holds += same[self.rows]
            if asks["type"]:
                holds += self._typed(self.types[q])
            for c, (held, asked) in self.stated.items():
                if asks[c]:
                    applies = applies + (held[self.rows] >= 0)
                    holds += held[self.rows] == asked[q]
            with np.errstate(invalid="ignore"):
                out[n] = np.where(applies == 0, 0.5, holds / applies) if np.ndim(applies) or applies else 0.5
        return out


def _fitting(x: pa.Table, y: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries that filter alike, and the products that they leave: number arrays."""
    (p_cat, q_cat, p_fam, q_fam), names = _codes(*(t.column(c) for c in ("cat", "fam") for t in (x, y)))
    anything = names.index("all") if "all" in names else -1
    (p_brand, q_brand), _ = _codes(x.column("brand"), y.column("brand"))
    (p_sex, q_sex), names = _codes(x.column("gender"), y.column("gender"))
    suits_all = np.array([n == "" or n in UNISEX for n in names] + [True])
    needs, shown = y.column("needs").to_numpy(), x.column("shown").to_numpy()
    sizes = [y.column(c).combine_chunks().value_lengths().fill_null(-1).to_numpy() for c in ("v", "tv")]
    keys = np.stack([*sizes, *(y.column(c).to_numpy() for c in ("has_image", "has_text")), needs, q_cat, q_fam, q_brand, q_sex], 1).astype(np.int64)
    _, of = np.unique(keys, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    for queries in np.split(order, np.flatnonzero(np.diff(of.ravel()[order])) + 1):
        q = queries[0]
        fits = ~(needs[q] & ~shown)
        if q_cat[q] >= 0 and q_cat[q] != anything:
            fits &= (p_cat < 0) | (p_cat == anything) | (p_cat == q_cat[q]) | (p_fam == q_cat[q]) | (p_cat == q_fam[q])
        if q_brand[q] >= 0:
            fits &= p_brand == q_brand[q]
        if not suits_all[q_sex[q]]:
            fits &= suits_all[p_sex] | (p_sex == q_sex[q])
        if fits.any():
            yield queries, np.flatnonzero(fits)


def best_matches(queries: DataFrame, products: DataFrame, weights: dict[str, tuple[float, float, float]], k: int, least: float, band: float, reach: int, digits: int) -> DataFrame:
    """(query_id, product_id, visual, text, attribute, final, stage, image_quality): pairs that fit, among them all of each query's ``k`` best.

    Both sides are dealt into blocks by the hash of their ids, each two blocks meet in a
    task. It estimates all pairs' scores by a product of matrices, then takes those exactly
    that may be among the ``k`` best of the block: by the band of the rounded score, then
    quality, score and smaller product_id. Exact scores are summed as Spark sums them.
    """
    spark = products.sparkSession
    n_products, n_queries = products.count(), queries.count()
    most = min(4 * spark.sparkContext.defaultParallelism, -(-n_products // LEAST_BLOCK))
    parts, blocks = max(1, -(-n_products // PRODUCT_BLOCK), most), max(1, -(-n_queries // QUERY_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    measured = [norm(c).alias(f"{c}_length") for c in ("v", "tv")]
    p = products.select("*", *measured).select(deal("product_id", parts).alias("bp"), every(blocks).alias("bq"), "*")
    q = queries.select("*", *measured).select(every(parts).alias("bp"), deal("query_id", blocks).alias("bq"), "*")
    kinds = [("query_id", queries.schema["query_id"].dataType), ("product_id", products.schema["product_id"].dataType), *((n, T.DoubleType()) for n in ("visual", "text", "attribute", "final")), ("stage", T.StringType()), ("image_quality", T.DoubleType())]
    rounding = 0.5 / 10**digits + 1e-6

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [(np.array([], int),) * 2 + (np.array([]),) * 4 + (np.array([], np.int8),)]
        if x.num_rows and y.num_rows:
            x = x.take(pc.sort_indices(x, sort_keys=[("product_id", "ascending")], null_placement="at_start"))
            quality = np.nan_to_num(x.column("image_quality").to_numpy(), nan=np.inf)
            image, text = y.column("has_image").to_numpy(), y.column("has_text").to_numpy()
            sides = [(_Vectors(x.column(c), x.column(f"{c}_length")), _Vectors(y.column(c), y.column(f"{c}_length"))) for c in ("v", "tv")]
            equal, aspects = _Equal(x, y, reach), _Aspects(x, y)
            for asked, rows in _fitting(x, y):
                asked = asked[np.argsort(aspects.of[asked], kind="stable")]
                equal.among(rows)
                aspects.among(rows)
                scaled = [p.scaled(n, rows).T if (n := q.dim[asked[0]]) >= 0 else None for p, q in sides]
                has_image, has_text = image[asked[0]], text[asked[0]]
                weight = weights["both" if has_image and has_text else "image" if has_image else "text"]
                step = max(1, PAIRS // len(rows))
                for at in range(0, len(asked), step):
                    found.append(scored(asked[at : at + step], rows, sides, scaled, equal, aspects, quality, weight, has_image, has_text))
        i, j, v, t, a, final, stage = (np.concatenate(c) for c in zip(*found))
        names = pa.array([*STAGES, None], pa.string()).take(pa.array(stage))
        out = [y.column("query_id").take(pa.array(i)), x.column("product_id").take(pa.array(j)), *map(pa.array, (v, t, a, final)), names, x.column("image_quality").take(pa.array(j))]
        return pa.table(out, names=[n for n, _ in kinds])

    def scored(asked: np.ndarray, rows: np.ndarray, sides: list, scaled: list, equal: _Equal, aspects: _Aspects, quality: np.ndarray, weight: tuple[float, float, float], has_image: bool, has_text: bool) -> tuple[np.ndarray, ...]:
        """One group's queries against its products: the rows of ``best`` as arrays."""
        wv, wt, wa = weight
        (pv, qv), (pt, qt) = sides
        aspect, of = np.unique(aspects.of[asked], return_inverse=True)
        aspect = aspects.first[aspect]
        attribute = aspects.attributes(aspect)
        overlap = aspects.overlaps(aspect) if has_text else np.zeros_like(attribute)
        dim, text_dim = qv.dim[asked[0]], qt.dim[asked[0]] if has_text else -1
        like, worded = pv.dim[rows] == dim, pt.dim[rows] == text_dim
        base = (wt * overlap + wa * attribute).astype(np.float32)[of]
        slack = rounding + 2.0**-23 * (max(dim, 0) + max(text_dim, 0) + 16)

        def alike(side: int, n: int, compared: np.ndarray) -> np.ndarray:
            """About the cosines, from 0 on."""
            with np.errstate(all="ignore"):
                out = sides[side][1].scaled(n, asked) @ scaled[side]
            np.maximum(out, 0, out=out)
            if not compared.all():
                out[:, ~compared] = 0
            return out

        def exact(side: int, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            p, q = sides[side]
            c = cosines(q.of(n), p.of(n), asked[i], rows[j], q.length, p.length) if len(i) else np.zeros(0)
            return np.where(c <= 0, 0.0, c)

        by_text = text_dim >= 0 and worded.any()
        if by_text:
            base = np.float32(wt) * np.maximum(overlap.astype(np.float32)[of], alike(1, text_dim, worded)) + (wa * attribute).astype(np.float32)[of]
        score = base
        key, sure, stage_of = np.array([], int), np.array([]), np.array([], np.int8)
        if has_image:
            key, sure, stage_of = equal.pairs(asked)
            met = np.take(base, key) + np.float32(wv) * sure.astype(np.float32)
            if dim >= 0 and like.any():
                score = alike(0, dim, like)
                score *= np.float32(wv)
                score += base
                score[:, ~like] = -np.inf
            else:
                score = np.full_like(base, -np.inf)
            np.put(score, key, met)
        strange = np.isnan(score) if np.isnan(score.sum()) else None
        known = score if strange is None else np.where(strange, -np.inf, score)
        edge = np.full(len(asked), least - slack)
        if len(rows) > k:
            kth = np.partition(known, len(rows) - k, axis=1)[:, len(rows) - k].astype(np.float64)
            edge = np.maximum(edge, band * np.floor((kth - slack) / band - 1e-9) - 1e-9 - slack)
        # a score of -inf is a pair that doesn't compare, and below every edge
        likely = known >= edge.astype(np.float32)[:, None]
        i, j = np.nonzero(likely if strange is None else likely | strange)
        stage, v = np.full(len(i), 3, np.int8), np.zeros(len(i))
        if has_image:
            at = np.minimum(np.searchsorted(key, i * len(rows) + j), max(len(key) - 1, 0))
            hit = key[at] == i * len(rows) + j if len(key) else np.zeros(len(i), bool)
            v[hit], stage[hit] = sure[at[hit]], stage_of[at[hit]]
            v[~hit], stage[~hit] = exact(0, dim, i[~hit], j[~hit]), 2
        t, a = overlap[of[i], j], attribute[of[i], j]
        if by_text:
            c = np.flatnonzero(worded[j])
            t[c] = np.maximum(t[c], exact(1, text_dim, i[c], j[c]))
        final = wv * v + wt * t + wa * a
        shown = round_half_up(final, digits)
        with np.errstate(invalid="ignore"):
            kept = np.flatnonzero(~(shown < least))
            i, j, v, t, a, final, stage, shown = (c[kept] for c in (i, j, v, t, a, final, stage, shown))
            order = np.lexsort((j, -np.nan_to_num(shown, nan=np.inf), -quality[rows[j]], -np.nan_to_num(np.floor(shown / band)), i))
        order = order[first_of_each([i[order]], k)] if len(order) else order
        return asked[i[order]], rows[j[order]], *(c[order] for c in (v, t, a, final, stage))

    return p.groupBy("bp", "bq").cogroup(q.groupBy("bp", "bq")).applyInArrow(best, T.StructType([T.StructField(n, kind) for n, kind in kinds]))
