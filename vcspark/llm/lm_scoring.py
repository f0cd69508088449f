"""Stupid-backoff language-model scores of all documents against the rest of the corpus.

Count tables of words and bigrams are partitioned by hash, joined to each document's own
n-grams, and summed by document. Words are counted by grouped aggregation; the counts of the
most frequent ones, a table of bounded size, go to all tasks. With them a text's words are
scored where it is read, and its bigrams are keyed by two places in that table. Bigrams of
two very frequent words are counted ahead, into a matrix of fixed size. The others are
shuffled once: a block of lines (bigram, row, how often the row has it and its words) for
each batch of texts and hash bucket. A bucket's task counts each bigram over all its lines
and joins that count back to them in the same place, so bigrams that occur once go no
further; the sums return to their documents in blocks too. Words beyond the bounded table,
and bigrams with such a word, come by shuffled joins of rows; a filter of fixed size, of the
words there that occur more than once, spares nearly all that occur nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vcspark.llm.frequent import most_frequent
from vcspark.llm.textops import batches, combine, mix, word_hashes
from vcspark.sources.shared import save_shared

BACKOFF = 0.4
#: Words whose counts go to all tasks, and of these the words whose pairs' counts do.
FREQUENT, TOP = 1 << 21, 512
#: Words of the corpus for each hash bucket.
BUCKET_WORDS = 1_000_000
#: Bits of the filter of repeated words beyond the table.
FILTER_BITS = 1 << 27
MICRO = 1_000_000
_U = np.uint64
_BATCH = 2 << 20
_PLACE = _U(32)
_SUMS = ["part", "unseen", "hits", "words", "rows"]


def micro_log(x: Column) -> Column:
    """Natural logarithms in millionths, as whole numbers, so that sums don't depend on their order."""
    return F.rint(F.log(x) * MICRO).cast("long")


def _micro_log(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log(np.maximum(x, 1)) * MICRO).astype(np.int64)


def _backed_off(elsewhere: np.ndarray, penalty: int) -> np.ndarray:
    return np.where(elsewhere > 0, _micro_log(elsewhere), penalty)


def _longs(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == _U else values.astype(np.int64), mask=null)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as bytes, equal places of the numbers together, compressed."""
    wide = [c.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T.tobytes() for c in map(np.ascontiguousarray, columns)]
    sizes = np.array([len(c) for c in columns], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(wide))


def _unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    out, at = [], 8 * columns
    for n in np.frombuffer(raw, np.int64, columns).tolist():
        out.append(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T.copy().view(np.int64).reshape(-1))
        at += 8 * n
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first value first; sums modulo 2**64 give the values back."""
    return np.diff(values.view(_U), prepend=_U(0)).view(np.int64)


def _ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids, 0 where null, and which are null."""
    column = rows.column("doc_id")
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count): how often all texts have each word."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in batches(part, "text", _BATCH):
                one, count = np.unique(word_hashes(rows.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([_longs(one), _longs(count)], names=["word", "count"])

    return docs.select("text").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _positions(words: np.ndarray, slots: int) -> list[np.ndarray]:
    return [mix(words + _U(seed)) % _U(64 * slots) for seed in (1, 2)]


def word_filter(words: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``word``; the parts are joined by grouping, what arrives is of fixed size."""

    slots = -(-FILTER_BITS // 64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = np.unique(np.concatenate(_positions(part.column("word").to_numpy(zero_copy_only=False).view(_U), slots)))
            slot = at >> _U(6)
            first = np.flatnonzero(np.diff(slot, prepend=~slot[:1]))
            bits = np.bitwise_or.reduceat(_U(1) << (at & _U(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([_longs(slot[first]), _longs(bits)], names=["slot", "bits"])

    out = np.zeros(slots, _U)
    found = words.select("word").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return out


def _maybe(words: np.ndarray, filled: np.ndarray | None) -> np.ndarray:
    """Whether the filter may hold the words."""
    if filled is None:
        return np.zeros(len(words), bool)
    a, b = ((filled[at >> _U(6)] >> (at & _U(63)) & _U(1)) > 0 for at in _positions(words, len(filled)))
    return a & b


class _Text:
    """A batch's words: ``row`` of each, ``place`` in the table (-1: not in it), ``tf`` in its row, and ``second``, where those begin that follow another."""

    def __init__(self, rows: pa.RecordBatch, table: np.ndarray) -> None:
        self.words, self.counts = word_hashes(rows.column("text"))
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        one, inverse = np.unique(self.words, return_inverse=True)
        at = np.minimum(np.searchsorted(table, one), max(len(table) - 1, 0))
        found = np.where(table[at] == one, at, -1) if len(table) else np.full(len(one), -1)
        self.place = found[inverse]
        _, inverse, tf = np.unique(self.row * (len(one) + 1) + inverse, return_inverse=True, return_counts=True)
        self.tf = tf[inverse]
        first = np.zeros(len(self.words), bool)
        first[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = True
        self.second = np.flatnonzero(~first)

    def by_row(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` of the words ``at`` by row, exact."""
        out = np.zeros(len(self.counts), np.int64)
        np.add.at(out, self.row[at], values)
        return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys (the last one first), where each run of equal keys begins in it, and its length."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    at = np.flatnonzero(new)
    return order, at, np.diff(at, append=len(order))


def top_pairs(docs: DataFrame, model) -> np.ndarray:
    """How often all texts have each pair of top words, as a matrix."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, top = model.value["words"], model.value["top"]
        total = np.zeros(model.value["tops"] ** 2, np.int64)
        for part in parts:
            for rows in batches(part, "text", _BATCH):
                text = _Text(rows, table)
                t = np.where(text.place >= 0, top[text.place], -1).astype(np.int64)
                a, b = t[text.second - 1], t[text.second]
                both = (a >= 0) & (b >= 0)
                total += np.bincount(a[both] * model.value["tops"] + b[both], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([_longs(at), _longs(total[at])], names=["pair", "n"])

    tops = model.value["tops"]
    out = np.zeros((tops, tops), np.int64)
    if tops:
        found = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # a row for each pair of top words at most
        out.reshape(-1)[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out


def _sum_block(ids: np.ndarray, null: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
    """Sums by id: the distinct (null, id) in order, as a block."""
    order, at, _ = _runs(ids, null)
    total = [np.add.reduceat(s[order], at) if len(at) else s[:0] for s in sums]
    first = order[at]
    return ids[first], _packed(_steps(ids[first]), null[first], *total)


def text_blocks(docs: DataFrame, model, pairs, buckets: int, penalty: int) -> DataFrame:
    """(bucket, kind, block): the sums of each batch's rows (kind 0), and the lines of their other bigrams by hash (kind 1)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count, top, tops = (model.value[k] for k in ("words", "counts", "top", "tops"))
        matrix = pairs.value
        for part in parts:
            for rows in batches(part, "text", _BATCH):
                text = _Text(rows, table)
                ids, null = _ids(rows)
                known = text.place >= 0
                rest = np.where(known, count[text.place] - text.tf if len(count) else 0, 0)
                base = np.where(known, _backed_off(rest, penalty), penalty)
                unknown = np.flatnonzero(~known)
                base[unknown[_maybe(text.words[unknown], model.value["filter"])]] = 0  # by joined rows
                every = np.arange(len(text.words))
                part_sum = text.by_row(every, base) + np.maximum(text.counts - 1, 0) * penalty
                gone, hits = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                out: list[tuple[int, int, bytes]] = []

                b = text.second
                t = np.where(known, top[text.place], -1).astype(np.int64) if tops else np.full(len(known), -1)
                b = b[(rest[b - 1] > 0) & (rest[b] > 0)]  # a bigram of a word that occurs nowhere else doesn't either
                near = (t[b - 1] >= 0) & (t[b] >= 0)
                n = b[near]
                if len(n):
                    pair = t[n - 1] * tops + t[n]
                    order, at, tf = _runs(pair, text.row[n])
                    n, pair = n[order[at]], pair[order[at]]
                    elsewhere = matrix.reshape(-1)[pair] - tf
                    gain = np.where(elsewhere > 0, _micro_log(elsewhere) - _micro_log(rest[n - 1]) - penalty - _backed_off(rest[n], penalty), 0)
                    part_sum += text.by_row(n, gain * tf)
                    hits += text.by_row(n, np.where(elsewhere > 0, tf, 0))
                gone -= hits
                _, block = _sum_block(ids, null, [part_sum, text.counts + gone, hits, text.counts, np.ones(len(ids), np.int64)])
                out.append((int(mix(ids[:1].view(_U) + _U(1))[0] % _U(buckets)), 0, block))

                far = b[~near]
                key = (text.place[far - 1].astype(_U) << _PLACE) | text.place[far].astype(_U)
                order, at, tf = _runs(text.row[far], key)
                far, key = far[order[at]], key[order[at]]
                bucket = (mix(key) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
                for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                    o = order[begin:end]
                    used, line = np.unique(text.row[far[o]], return_inverse=True)
                    out.append((int(bucket[o[0]]), 1, _packed(_steps(key[o].view(np.int64)), line, tf[o], text.tf[far[o] - 1], text.tf[far[o]], _steps(ids[used]), null[used])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "kind", "block"])

    return docs.mapInArrow(run, "bucket long, kind int, block binary")


def _sums_by_document(ids: np.ndarray, null: np.ndarray, sums: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of sums for each slot of ids."""
    slot = (mix(ids.view(_U) + _U(1)) % _U(buckets)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    ends = np.flatnonzero(np.diff(slot[order], append=-1)) + 1
    for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        o = order[begin:end]
        yield int(slot[o[0]]), _sum_block(ids[o], null[o], [s[o] for s in sums])[1]


def bucket_sums(blocks: DataFrame, model, buckets: int, penalty: int) -> DataFrame:
    """(slot, block): sums by document, of the batches' own sums and of the bigrams that occur elsewhere."""

    def run(group: pa.Table) -> pa.Table:
        count = model.value["counts"]
        out: list[tuple[int, bytes]] = []
        lines, first = [], 0
        for kind, block in zip(group.column("kind").to_pylist(), group.column("block")):
            if kind == 0:
                ids, null, *sums = _unpacked(block.as_py(), 7)
                out += _sums_by_document(np.cumsum(ids.view(_U)).view(np.int64), null, sums, buckets)
            else:
                key, line, tf, tf1, tf2, ids, null = _unpacked(block.as_py(), 7)
                lines.append((np.cumsum(key.view(_U)), line + first, tf, tf1, tf2, np.cumsum(ids.view(_U)).view(np.int64), null))
                first += len(ids)
        if lines:
            key, line, tf, tf1, tf2, ids, null = (np.concatenate(c) for c in zip(*lines))
            del lines
            order = np.argsort(key)
            key, tf = key[order], tf[order]
            at = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
            elsewhere = np.repeat(np.add.reduceat(tf, at), np.diff(at, append=len(key))) - tf
            hit = elsewhere > 0
            key, tf, elsewhere, order = key[hit], tf[hit], elsewhere[hit], order[hit]
            rest1 = count[(key >> _PLACE).astype(np.int64)] - tf1[order]
            rest2 = count[(key & _U(0xFFFFFFFF)).astype(np.int64)] - tf2[order]
            gain = (_micro_log(elsewhere) - _micro_log(rest1) - penalty - _backed_off(rest2, penalty)) * tf
            line, zero = line[order], np.zeros(len(tf), np.int64)
            out += _sums_by_document(ids[line], null[line], [gain, -tf, tf, zero, zero], buckets)
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["slot", "block"])

    return blocks.groupBy("bucket").applyInArrow(run, "slot long, block binary")


def document_sums(blocks: DataFrame) -> DataFrame:
    """(doc_id, part, unseen, hits, words, rows) from blocks by slot."""

    def run(group: pa.Table) -> pa.Table:
        found = [_unpacked(block.as_py(), 7) for block in group.column("block")]
        ids = np.concatenate([np.cumsum(c[0].view(_U)).view(np.int64) for c in found])
        null = np.concatenate([c[1] for c in found])
        order, at, _ = _runs(ids, null)
        sums = [np.add.reduceat(np.concatenate([c[i] for c in found])[order], at) for i in range(2, 7)]
        first = order[at]
        return pa.table([_longs(ids[first], null[first] > 0), *map(_longs, sums)], names=["doc_id", *_SUMS])

    return blocks.groupBy("slot").applyInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in _SUMS))


def rare_lines(docs: DataFrame, model) -> DataFrame:
    """(doc_id, w1, w2, tf, tf1, tf2, c1, c2): each row's words beyond the table (w1 null) and its bigrams with one; counts are null where the word isn't in the table.

    Words that the filter excludes, and words of the table that no other row has, are left out with their bigrams.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count = model.value["words"], model.value["counts"]
        for part in parts:
            for rows in batches(part, "text", _BATCH):
                text = _Text(rows, table)
                rare = text.place < 0
                counted = count[text.place] if len(count) else np.zeros(len(rare), np.int64)
                useful = np.where(rare, False, counted > text.tf)
                w = np.flatnonzero(rare)
                useful[w] = _maybe(text.words[w], model.value["filter"])
                w = w[useful[w]]
                order, at, _ = _runs(text.words[w], text.row[w])
                w = w[order[at]]
                b = text.second[rare[text.second] | rare[text.second - 1]]
                b = b[useful[b] & useful[b - 1]]
                order, at, tf = _runs(text.words[b - 1], text.words[b], text.row[b])
                b = b[order[at]]
                one = np.arange(len(w) + len(b)) < len(w)
                last, before = np.concatenate([w, b]), np.concatenate([w, b - 1])
                arrays = [rows.column("doc_id").take(pa.array(text.row[last])), _longs(text.words[before], one), _longs(text.words[last]), _longs(np.concatenate([text.tf[w], tf])), _longs(text.tf[before]), _longs(text.tf[last])]
                yield pa.RecordBatch.from_arrays([*arrays, _longs(counted[before], one | rare[before]), _longs(counted[last], rare[last])], names=["doc_id", "w1", "w2", "tf", "tf1", "tf2", "c1", "c2"])

    return docs.mapInArrow(run, "doc_id long, w1 long, w2 long, tf long, tf1 long, tf2 long, c1 long, c2 long")


def _rare_sums(lines: DataFrame, words: DataFrame, penalty: int) -> DataFrame:
    """(doc_id, part, unseen, hits, words, rows) of the words beyond the table and of the bigrams with one."""
    backed = lambda rest: F.when(rest > 0, micro_log(rest)).otherwise(penalty)
    zero = F.lit(0).cast("long")
    single = lines.where("w1 is null").join(words.withColumnRenamed("word", "w2"), "w2")
    singles = single.select("doc_id", (F.col("tf") * backed(F.col("count") - F.col("tf"))).alias("part"), zero.alias("unseen"), zero.alias("hits"))
    grams = lines.where("w1 is not null")
    counted = grams.groupBy("w1", "w2").agg(F.sum("tf").alias("c12"), F.max("c1").alias("c1"), F.max("c2").alias("c2")).where("c12 > 1")
    for end in "12":
        counted = save_shared(counted, "lm-rare-bigrams")
        looked = counted.where(F.col(f"c{end}").isNull()).drop(f"c{end}").join(words.select(F.col("word").alias(f"w{end}"), F.col("count").alias(f"c{end}")), f"w{end}")
        counted = counted.where(F.col(f"c{end}").isNotNull()).unionByName(looked)
    met = grams.drop("c1", "c2").join(save_shared(counted, "lm-rare-bigrams"), ["w1", "w2"])
    elsewhere = F.col("c12") - F.col("tf")
    gain = micro_log(elsewhere) - micro_log(F.col("c1") - F.col("tf1")) - penalty - backed(F.col("c2") - F.col("tf2"))
    gains = met.where(elsewhere > 0).select("doc_id", (gain * F.col("tf")).alias("part"), (-F.col("tf")).alias("unseen"), F.col("tf").alias("hits"))
    sums = singles.unionByName(gains).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("part", "unseen", "hits")])
    return sums.select("doc_id", "part", "unseen", "hits", zero.alias("words"), zero.alias("rows"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, words, seen, log_score, mean_log_score), one row for each row of ``docs``.

    The model counts words and bigrams of all documents; a document is scored with its
    own counts taken off. A word w2 after w1 scores c(w1 w2) / c(w1) if that bigram
    occurs elsewhere (``seen`` counts these), else ``backoff`` * c(w2) / N; the first
    word scores c(w2) / N, and a word that occurs nowhere else counts ``backoff`` for
    c(w2). ``log_score`` sums the natural logarithms, each rounded to millionths,
    ``mean_log_score`` is by word (null without words). Words are runs of anything but
    space and U+0009..U+000D, A-Z lower-cased, told apart by 64-bit hashes. Null and
    empty texts score 0. Rows that repeat an id are each taken off for themselves and
    show the sum of all their rows, N without all of them; null ids count as one id. Other
    columns are not read.
    """
    penalty = round(np.log(backoff) * MICRO)
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = save_shared(word_counts(source), "lm-words")
    total = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first().n
    repeated = words.where("count > 1")  # other words occur nowhere else
    common = most_frequent(repeated, FREQUENT).select("word", "count").toArrow().combine_chunks()  # FREQUENT rows at most
    table, counts = common["word"].to_numpy().view(_U), common["count"].to_numpy()
    order = np.argsort(table)
    table, counts = table[order], counts[order]
    del common, order
    beyond = repeated.where(F.col("count") < int(counts.min())) if len(counts) else repeated
    filled = None if repeated.count() == len(table) else word_filter(beyond)  # None: no word beyond the table occurs twice
    top = np.full(len(table), -1, np.int32)
    most = np.lexsort((table, -counts))[:TOP]
    top[most] = np.arange(len(most))
    model = context.broadcast({"words": table, "counts": counts, "top": top, "tops": len(most), "filter": filled})
    pairs = context.broadcast(top_pairs(source, model))
    buckets = max(1, -(-total // BUCKET_WORDS))

    sums = document_sums(bucket_sums(text_blocks(source, model, pairs, buckets, penalty), model, buckets, penalty))
    if filled is not None:
        sums = sums.unionByName(_rare_sums(save_shared(rare_lines(source, model), "lm-rare"), words, penalty)).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    rest = micro_log(F.greatest(F.lit(total) - F.col("words"), F.lit(1)))
    log_score = ((F.col("part") - F.col("unseen") * rest) / MICRO).alias("log_score")
    out = sums.select("doc_id", "words", F.col("hits").alias("seen"), log_score, F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row")).drop("row")
    return out.withColumn("mean_log_score", F.when(F.col("words") > 0, F.col("log_score") / F.col("words")))
