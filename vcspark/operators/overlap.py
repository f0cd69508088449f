"""Which texts hold most of a query's words: every query against every text, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of texts and of queries, and word hits counted at a time.
TEXTS, QUERIES, HITS = 2048, 2048, 1 << 22


def word_counts(row: np.ndarray, word: np.ndarray, n_rows: int, item: np.ndarray, first: np.ndarray, n_items: int) -> np.ndarray:
    """How many of each item's words each row has; ``row`` doesn't fall, ``item[first[w] : first[w + 1]]`` hold word ``w``."""
    out = np.zeros((n_rows, n_items), np.int32)
    held = first[word + 1] - first[word]
    total = np.cumsum(held)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, side="right")))
        n, start = held[at:to], first[word[at:to]]
        hit = item[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)]
        low, high = row[at], row[to - 1] + 1
        cells = np.repeat(row[at:to] - low, n) * n_items + hit
        out[low:high] += np.bincount(cells, minlength=(high - low) * n_items).reshape(-1, n_items).astype(np.int32)
        at = to
    return out


def overlap_topk(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, overlap, rank): the ``k`` texts that hold most of each query's words, ties to the smaller doc_id.

    ``texts`` (doc_id long, pt) and ``queries`` (item_id long, qt) have arrays of
    distinct words. Rows that share an id are one text or query, each word as often as
    rows have it. Texts and queries are dealt into blocks, each two meet in a task,
    and only a block's best go on: no row of a text and a query is shuffled.
    """
    asked = queries.where("item_id is not null").groupBy("item_id").agg(F.flatten(F.collect_list("qt")).alias("qt"))
    parts, blocks = max(1, -(-texts.count() // TEXTS)), max(1, -(-queries.count() // QUERIES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.select(deal("doc_id", parts).alias("p"), every(blocks).alias("b"), "doc_id", "pt")
    right = asked.select(every(parts).alias("p"), deal("item_id", blocks).alias("b"), "item_id", "qt")

    def best(docs: pa.Table, items: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("item_id", "doc_id", "c", "n")})
        if not docs.num_rows or not items.num_rows:
            return empty
        docs = docs.take(pc.sort_indices(docs.column("doc_id"), null_placement="at_start")).combine_chunks()
        ids, items = docs.column("doc_id").combine_chunks(), items.combine_chunks()
        plain, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        starts = np.r_[True, (plain[1:] != plain[:-1]) | (null[1:] != null[:-1])]
        text = np.cumsum(starts) - 1
        asked_words = items.column("qt").combine_chunks()
        n = asked_words.value_lengths().to_numpy()
        names = pc.unique(asked_words.flatten())
        name = pc.index_in(asked_words.flatten(), value_set=names).to_numpy()
        item = np.repeat(np.arange(len(n)), n)[np.argsort(name, kind="stable")]
        first = np.r_[0, np.cumsum(np.bincount(name, minlength=len(names)))]
        has = docs.column("pt").combine_chunks()
        word = pc.index_in(has.flatten(), value_set=names)
        known = word.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(text, has.value_lengths().to_numpy())[known]
        n_texts = int(text[-1]) + 1
        counts = word_counts(row, word.drop_null().to_numpy().astype(np.int64), n_texts, item, first, len(n))
        # as the result rounds: four digits, halves up
        share = (20_000 * counts.astype(np.int64) + n) // (2 * np.maximum(n, 1))
        key = share * n_texts + np.arange(n_texts - 1, -1, -1)[:, None]
        key[counts == 0] = -1
        top = np.argpartition(-key, min(k, n_texts) - 1, axis=0)[:k]
        of = np.broadcast_to(np.arange(len(n)), top.shape)
        good = key[top, of] >= 0
        top, of = top[good], of[good]
        return pa.table({"item_id": items.column("item_id").take(pa.array(of)), "doc_id": ids.take(pa.array(np.flatnonzero(starts)[top])), "c": pa.array(counts[top, of], pa.int64()), "n": pa.array(n[of], pa.int64())})

    met = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(best, "item_id long, doc_id long, c long, n long")
    rows = met.select("item_id", "doc_id", F.round(F.col("c") / F.col("n"), 4).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)
