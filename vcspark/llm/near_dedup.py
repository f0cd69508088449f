"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its distinct word shingles, as 64-bit hashes; its sketch is
the ``k`` smallest. Documents with equal sets form a class, and one of each class goes
on. Steps:

1. Inverted lists: each class lists the rarest of its retained values - so many that
   two sets of the wanted similarity must meet in ``MEETINGS`` lists.
2. Estimation: pairs that meet so often in short lists, and all members of each longer
   list, are compared on the sketch of their union. Of a longer list a task emits a
   spanning forest of what may be similar, never pairs. What pairs and forests join is
   a candidate group.
3. Verification: the members of a candidate group meet with their full sets, and a
   spanning forest of the exact links comes out.

A list or group larger than a block is dealt over tasks: each block meets the first
one, and only members that are still apart from the bulk then meet all blocks. So rows
grow with members (and with members times the blocks of those apart), and a task holds
two blocks, however large a group of copies is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vcspark.llm.components import connected_components
from vcspark.llm.frequent import most_frequent
from vcspark.llm.textops import batches, list_column, shingles, word_hashes
from vcspark.operators.skew import salted_join, semi_join_ids
from vcspark.sources.shared import drop_shared, save_shared

SKETCH = 64
MISS = 1e-7
FREQUENT = 1 << 17
BLOCK = 1024
BLOCK_VALUES = 1 << 19
SMALL_LIST = 16
MEETINGS = 2
#: So much text at a time is cut into words.
BATCH_BYTES = 2 << 20
#: Pairs are made in lists of up to so many members.
PAIRED = 8


def least_hits(trials: int, chance: float, miss: float = MISS) -> int:
    """The largest number that a binomial count stays below with a chance of at most ``miss``."""
    total, hits = 0.0, 0
    while hits < trials:
        total += comb(trials, hits) * chance**hits * (1 - chance) ** (trials - hits)
        if total > miss:
            break
        hits += 1
    return hits


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, sketch: int | None, key_col: str | None = None) -> DataFrame:
    """(doc_id, key, n, digest, values): the size and digest of each text's shingle set, and the set or its ``sketch`` smallest values."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in batches(part, "text", BATCH_BYTES):
                sets = list(shingles(*word_hashes(rows.column("text")), width))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), list_column([s[:sketch] for s in sets], pa.int64())],
                    names=["doc_id", "key", "n", "digest", "values"],
                )

    key = F.col(key_col).cast("binary") if key_col else F.lit(None).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, key binary, n long, digest binary, values array<long>")


class _Limits:
    """What a similarity of at least ``percent`` / 100 implies for sizes and retained values."""

    def __init__(self, percent: int, k: int) -> None:
        self.percent, self.k = percent, k
        self.full = percent * k // 100
        self.overlap = max(1, least_hits(k, percent / 100))

    def listed(self, n: int) -> int:
        """How many of its rarest retained values a set of ``n`` lists, to meet each similar set ``MEETINGS`` times.

        Sets that share fewer values (two of one shingle each) are similar only if equal, so they are one class.
        """
        least = -(-self.percent * n // 100) if n <= self.full else self.overlap
        return min(n, self.k) - least + min(MEETINGS, least)

    def sizes_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (100 * a >= self.percent * b) & (100 * b >= self.percent * a)


def _frequent(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent retained values, at most ``FREQUENT``, sorted, and their counts."""
    counted = save_shared(sketches.select(F.explode("values").alias("value")).groupBy("value").count().where("count > 1"), "near-frequent")
    top = most_frequent(counted, FREQUENT).toPandas().sort_values("value")
    drop_shared(counted)
    return top["value"].to_numpy(np.int64), top["count"].to_numpy(np.int64)


def _postings(sketches: DataFrame, limits: _Limits) -> DataFrame:
    """(value, cid, n, seen): each sketch under its rarest values, and how many sketches have the value if it is among the most frequent, else 0.

    The most frequent values come last, by count; the order of the others doesn't
    matter. Any fixed order is right, so the cut bounds only the broadcast.
    """
    frequent = sketches.sparkSession.sparkContext.broadcast(_frequent(sketches))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for part in parts:
            ids, sizes = part.column("cid").to_numpy(), part.column("n").to_numpy()
            values = part.column("values").flatten().to_numpy()
            ends = np.cumsum(np.minimum(sizes, limits.k))
            at = np.searchsorted(known, values)
            rank = np.zeros(len(values), np.int64)
            if len(known):
                at[at == len(known)] = 0
                hit = known[at] == values
                rank[hit] = counts[at[hit]]
            keep, who = [], []
            for i, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
                m = min(n, limits.k)
                order = np.argsort(rank[end - m : end], kind="stable")[: limits.listed(n)]
                keep.append(order + (end - m))
                who.append(np.full(len(order), i))
            keep, who = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keep, who))
            yield pa.RecordBatch.from_arrays([pa.array(values[keep]), pa.array(ids[who]), pa.array(sizes[who]), pa.array(rank[keep])], names=["value", "cid", "n", "seen"])

    return sketches.select("cid", "n", "values").mapInArrow(run, "value long, cid long, n long, seen long")


def _lists(limits: _Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (g, cid, n) sorted by value ``g``: (null, a, b) for each two of a short list whose sizes fit, (g, cid, null) for members of longer ones."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(parts):
            g, cids, n = (table.column(c).to_numpy() for c in ("g", "cid", "n"))
            sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)])
            size = np.repeat(sizes, sizes)
            a, b = [], []
            for gap in range(1, min(PAIRED, len(g))):
                left = np.flatnonzero((size[:-gap] <= PAIRED) & (g[:-gap] == g[gap:]))
                left = left[limits.sizes_fit(n[left], n[left + gap])]
                a.append(cids[left])
                b.append(cids[left + gap])
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
            long = size > PAIRED
            pairs = np.arange(len(a) + long.sum()) < len(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, g[long]]), mask=pairs), pa.array(np.concatenate([np.minimum(a, b), cids[long]])), pa.array(np.concatenate([np.maximum(a, b), cids[long]]), mask=~pairs)],
                names=["value", "a", "b"],
            )

    return run


def _fingerprints(sketches: DataFrame, k: int) -> DataFrame:
    """(cid, n, data): sketches with two bytes of each value, in the values' order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lengths = part.column("values").value_lengths().to_numpy()
            table = np.zeros((part.num_rows, k), np.uint16)
            table[np.arange(k) < lengths[:, None]] = part.column("values").flatten().to_numpy().astype(np.uint16)
            yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("n"), pa.array([row.tobytes() for row in table], pa.binary())], names=["cid", "n", "data"])

    return sketches.select("cid", "n", "values").mapInArrow(run, "cid long, n long, data binary")


def _whole_groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their group ``g``."""
    rest: pa.Table | None = None
    for part in parts:
        table = pa.Table.from_batches([part] if rest is None else [*rest.to_batches(), part])
        g = table.column("g").to_numpy()
        last = int(np.searchsorted(g, g[-1])) if len(g) else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def _spanning(cids: np.ndarray, labels: np.ndarray, pivots: np.ndarray, similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what is ``similar``, one for each two labels that become one.

    Each pivot is compared with all rows of other labels; ``similar(i, rows)`` returns
    those of ``rows`` that row ``i`` is similar to.
    """
    _, label = np.unique(labels, return_inverse=True)
    found = []
    for i in pivots.tolist():
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        hits = similar(i, others)
        if len(hits):
            names, first = np.unique(label[hits], return_index=True)
            found += [(int(cids[i]), int(cids[j])) for j in hits[first]]
            label[np.isin(label, names)] = label[i]
    return found


class _Estimate:
    """Whether sets may be similar enough, by the sketch of their union."""

    def __init__(self, limits: _Limits) -> None:
        self.limits = limits

    def __call__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """For rows of fingerprints ``a`` and ``b``: False only where the sets aren't similar, or with chance ``MISS``."""
        k, percent = self.limits.k, self.limits.percent
        at = np.arange(k, dtype=np.uint32)
        side = lambda x, n, s: ((np.where(at < n[:, None], x, np.uint32(0x10000 + s)).astype(np.uint32) * np.uint32(2) + np.uint32(s)) * np.uint32(k)) + at
        both = np.sort(np.concatenate([side(a, size_a, 0), side(b, size_b, 1)], axis=1), axis=1)
        print_of = both // np.uint32(2 * k)
        same = (print_of[:, 1:] == print_of[:, :-1]) & (print_of[:, 1:] < 0x10000)
        shared = same.sum(axis=1)
        whole = (size_a <= k) & (size_b <= k)
        good = np.where(whole, shared * 100 >= percent * (size_a + size_b - shared), shared >= self.limits.overlap)
        # the values that both retain also count only among the k smallest of the union
        look = np.flatnonzero(good & ~whole)
        if len(look):
            rows, same = both[look], same[look]
            ranks = (rows[:, 1:] % np.uint32(k)).astype(np.int64) + (rows[:, :-1] % np.uint32(k))
            cross = same & ((rows[:, 1:] // np.uint32(k)) % 2 != (rows[:, :-1] // np.uint32(k)) % 2)
            ranks = np.sort(np.where(cross, ranks, 1 << 30), axis=1)
            hits = (ranks - np.arange(ranks.shape[1]) < k).sum(axis=1) + (same & ~cross).sum(axis=1)
            good[look] = hits >= self.limits.overlap
        return good


def _may_link(limits: _Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate forests (a, b) of lists; rows are (g, cid, n, data, label, pivot), sorted by g and cid."""
    estimate = _Estimate(limits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(parts):
            g, cids, n, labels = (table.column(c).to_numpy() for c in ("g", "cid", "n", "label"))
            pivot = table.column("pivot").to_numpy()
            prints = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint16).reshape(-1, limits.k)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            sizes = np.diff(np.r_[starts, len(g)])
            small = np.repeat(sizes <= SMALL_LIST, sizes)
            a, b = [], []
            for gap in range(1, SMALL_LIST):
                left = np.flatnonzero(small[:-gap] & (g[:-gap] == g[gap:]) & (labels[:-gap] != labels[gap:]) & (pivot[:-gap] | pivot[gap:])) if len(g) > gap else np.zeros(0, np.int64)
                left = left[limits.sizes_fit(n[left], n[left + gap])]
                for at in range(0, len(left), 8192):
                    i = left[at : at + 8192]
                    good = i[estimate(prints[i], prints[i + gap], n[i], n[i + gap])]
                    a.append(cids[good])
                    b.append(cids[good + gap])
            for start, size in zip(starts[sizes > SMALL_LIST].tolist(), sizes[sizes > SMALL_LIST].tolist()):
                own = slice(start, start + size)
                p, m = prints[own], n[own]

                def similar(i: int, rows: np.ndarray, p: np.ndarray = p, m: np.ndarray = m) -> np.ndarray:
                    rows = rows[limits.sizes_fit(m[rows], m[i])]
                    if not len(rows):
                        return rows
                    return rows[estimate(np.broadcast_to(p[i], (len(rows), limits.k)), p[rows], np.full(len(rows), m[i]), m[rows])]

                links = _spanning(cids[own], labels[own], np.flatnonzero(pivot[own]), similar)
                a.append(np.array([x for x, _ in links], np.int64))
                b.append(np.array([y for _, y in links], np.int64))
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _link(limits: _Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forests (a, b) of exact links; rows are (g, cid, n, data, label, pivot) with full sets, sorted by g."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(parts):
            table = table.combine_chunks()
            g, cids, n, labels = (table.column(c).to_numpy() for c in ("g", "cid", "n", "label"))
            pivot = table.column("pivot").to_numpy()
            links = []
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist()
            for start, end in zip(starts, [*starts[1:], len(g)]):
                m = n[start:end]
                values = table.column("data").slice(start, end - start).combine_chunks().flatten().to_numpy()
                names, name = np.unique(values, return_inverse=True)
                owner = np.repeat(np.arange(end - start), m)[np.argsort(name, kind="stable")]
                first = np.r_[0, np.cumsum(np.bincount(name, minlength=len(names)))]
                own = np.r_[0, np.cumsum(m)]

                def similar(i: int, rows: np.ndarray, m: np.ndarray = m, name: np.ndarray = name, owner: np.ndarray = owner, first: np.ndarray = first, own: np.ndarray = own) -> np.ndarray:
                    mine = name[own[i] : own[i + 1]]
                    counts = first[mine + 1] - first[mine]
                    at = np.arange(counts.sum()) + np.repeat(first[mine] - np.r_[0, np.cumsum(counts)[:-1]], counts)
                    shared = np.bincount(owner[at], minlength=len(m))[rows]
                    return rows[100 * shared >= limits.percent * (m[rows] + m[i] - shared)]

                links += _spanning(cids[start:end], labels[start:end], np.flatnonzero(pivot[start:end]), similar)
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

    return run


def _forest(entries: DataFrame, payload: DataFrame, test: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(a, b): ``known`` links and those that ``test`` finds among the members of each key, enough to join all that it would; and their components, if made.

    ``entries`` is a saved table (key, cid, parts): members, and into how many blocks
    their key is dealt; ``payload`` (cid, n, data) is what ``test`` looks at. First
    each block meets the key's first block. Then the members outside the key's
    largest component - the ones still apart - meet all blocks.
    """

    def tested(rows: DataFrame) -> DataFrame:
        full = rows.join(payload, "cid").select("g", "cid", "n", "data", "label", "pivot")
        return full.repartition("g").sortWithinPartitions("g", "cid").mapInArrow(test, "a long, b long").distinct()

    block = F.pmod(F.xxhash64("cid"), "parts").cast("int")
    slots = F.when(F.col("parts") == 1, F.array(F.lit(0))).when(block == 0, F.sequence(F.lit(1), F.greatest(F.col("parts") - 1, F.lit(1)))).otherwise(F.array(block))
    near_first = entries.select("key", "cid", F.explode(slots).alias("slot")).select(F.xxhash64("key", "slot").alias("g"), "cid", F.col("cid").alias("label"), F.lit(True).alias("pivot"))
    links = tested(near_first)
    links = save_shared(links if known is None else links.union(known), f"{name}-first")
    large = entries.where("parts > 1")
    if large.isEmpty():
        return links, None
    component = connected_components(links)
    large = large.join(component.select(F.col("id").alias("cid"), "component"), "cid", "left").select("key", "cid", "parts", F.coalesce("component", "cid").alias("label"))
    large = save_shared(large, f"{name}-large")
    by_label = large.groupBy("key", "label").agg(F.count("*").alias("c"))
    bulk = by_label.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("bulk"), F.sum("c").alias("members"), F.max("c").alias("most"))
    bulk = save_shared(bulk.where("members > most").select("key", "bulk", "members", F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int").alias("apart")), f"{name}-bulk")
    rows = save_shared(salted_join(large, bulk, ["key"], "members", "cid", "inner"), f"{name}-apart")
    if rows.isEmpty():
        return links, component
    group = lambda r, b: F.xxhash64("key", r, b).alias("g")
    every = rows.withColumn("b", block).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("apart") - 1))).select(group("r", "b"), "cid", "label", F.lit(False).alias("pivot"))
    apart = rows.where("label <> bulk").withColumn("r", F.pmod(F.xxhash64("cid", F.lit(1)), "apart").cast("int"))
    apart = apart.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(group("r", "b"), "cid", "label", F.lit(True).alias("pivot"))
    more = save_shared(tested(every.union(apart)), f"{name}-more")
    return (links, component) if more.isEmpty() else (links.union(more), None)


def _good_pairs(limits: _Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs (a, b, n_a, n_b, data_a, data_b), those that may be similar."""
    estimate = _Estimate(limits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = (np.frombuffer(b"".join(part.column(f"data_{c}").to_pylist()), np.uint16).reshape(-1, limits.k) for c in "ab")
            good = estimate(a, b, *(part.column(f"n_{c}").to_numpy() for c in "ab")) if part.num_rows else np.zeros(0, bool)
            yield part.select(["a", "b"]).filter(pa.array(good))

    return run


def _candidates(sketches: DataFrame, limits: _Limits) -> DataFrame:
    """(cid, component): groups of classes that sketches can't tell to be unlike; classes alone have no row."""
    postings = save_shared(_postings(sketches, limits), "near-postings")
    prints = save_shared(_fingerprints(sketches, limits.k), "near-prints")
    rare = postings.where(F.col("seen") <= BLOCK).select(F.col("value").alias("g"), "cid", "n")
    lists = save_shared(rare.repartition("g").sortWithinPartitions("g").mapInArrow(_lists(limits), "value long, a long, b long"), "near-lists")

    met = lists.where("value is null").groupBy("a", "b").agg(F.count("*").alias("met")).where(F.col("met") >= MEETINGS).select("a", "b")
    side = lambda c: prints.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("data").alias(f"data_{c}"))
    pairs = save_shared(met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "data_a", "data_b").mapInArrow(_good_pairs(limits), "a long, b long"), "near-pairs")

    # a list's length, or for the frequent values how many sketches have it, says into how many blocks it goes
    longer = lists.where("value is not null").select("value", F.col("a").alias("cid"))
    length = save_shared(longer.groupBy("value").agg(F.count("*").alias("c")), "near-lengths")
    known = postings.where(F.col("seen") > BLOCK).select("value", "cid", F.col("seen").alias("c"))
    listed = salted_join(longer, length, ["value"], "c", "cid", "inner").select("value", "cid", "c").union(known)
    listed = save_shared(listed.select(F.col("value").alias("key"), "cid", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")), "near-listed")
    drop_shared(postings, lists, length)
    links, component = _forest(listed, prints, _may_link(limits), "near-candidates", pairs)
    component = connected_components(links) if component is None else component
    drop_shared(prints, listed)
    return component.select(F.col("id").alias("cid"), "component")


def _verified(docs: DataFrame, id_col: str, text_col: str, width: int, classes: DataFrame, candidates: DataFrame, limits: _Limits) -> tuple[DataFrame, DataFrame | None]:
    """(a, b): a forest of the exact links within candidate groups; and its components, if made."""
    members = save_shared(candidates.join(classes.select("cid", "rep", "digest", "n"), "cid"), "near-members")
    groups = members.groupBy("component").agg(F.count("*").alias("c"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_VALUES)).cast("int").alias("parts"))
    entries = salted_join(members.select("component", "cid"), save_shared(groups, "near-groups"), ["component"], "c", "cid", "inner")
    entries = save_shared(entries.select(F.col("component").alias("key"), "cid", "parts"), "near-entries")
    # one row of each class brings its full set; a class without an id is looked for among the rows without one
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    ids = save_shared(members.where("rep is not null").select(F.col("rep").alias("__id")).distinct(), "near-ids")
    wanted = semi_join_ids(rows, ids, "__id")
    if not members.where("rep is null").isEmpty():
        wanted = wanted.union(rows.where("__id is null"))
    sets = shingle_sets(wanted, "__id", "text", width, None).join(members.select("digest", "cid"), "digest")
    once = save_shared(sets.groupBy("cid").agg(F.first("n").alias("n"), F.first("values").alias("data")), "near-sets")
    found = _forest(entries, once, _link(limits), "near-links")
    drop_shared(once, entries, members)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = SKETCH, key_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Words are runs of anything but space and U+0009..U+000D, A-Z lower-cased; a set
    holds the distinct shingles of ``width`` words, or the whole sequence as one if
    there are fewer. Documents are linked if 100 * intersection >= ``percent`` * union,
    counted on full sets; ``component_id`` is the smallest id that links reach, and
    ``kept`` marks that document. Null or wordless texts have no shingles and no
    links. Rows with equal sets are linked. Rows that repeat an id are one document,
    so links of any of their texts are links of all. Rows with a null id are
    documents of their own, linked like others, but nobody's representative: their
    ``component_id`` is null, and they are kept, if their component has no other id.
    Columns beside those named are not read.

    With ``key_col`` (cast to binary), id and key together name a document, the result
    has that ``key`` too, and exactly one (id, key) of a component is kept: the
    smallest, null ids last.
    """
    limits = _Limits(percent, k)
    sets = save_shared(shingle_sets(docs, id_col, text_col, width, k, key_col), "near-sketches")
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = sets.where("n > 0").groupBy("digest").agg(F.min(name).alias("name"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("values").alias("values"))
    sketches = save_shared(classes.select(F.monotonically_increasing_id().alias("cid"), "digest", "name", F.col("name.doc_id").alias("rep"), "copies", "n", "values"), "near-classes")
    whole, sets = sets, save_shared(sets.drop("values"), "near-rows")
    drop_shared(whole)
    candidates = save_shared(_candidates(sketches, limits), "near-components")
    whole, classes = sketches, save_shared(sketches.drop("values"), "near-classes")
    drop_shared(whole)
    links, joined = _verified(docs, id_col, text_col, width, classes, candidates, limits)
    if key_col is None:
        repeated = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("doc_id")
        repeated = save_shared(repeated, "near-repeated")
        if not repeated.isEmpty():
            texts = sets.where("n > 0").join(repeated, "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "cid"), "digest")
            first = texts.groupBy("doc_id").agg(F.min("cid").alias("a"))
            links, joined = links.union(texts.join(first, "doc_id").where("a <> cid").select("a", F.col("cid").alias("b"))), None
    joined = connected_components(links) if joined is None else joined

    labelled = save_shared(joined.join(classes.select(F.col("cid").alias("id"), "name"), "id"), "near-labelled")
    least = save_shared(labelled.groupBy("component").agg(F.min("name").alias("least"), F.count("*").alias("c")), "near-least")
    named = salted_join(labelled.select("id", "component"), least, ["component"], "c", "id", "inner").select(F.col("id").alias("cid"), "least")
    component = save_shared(classes.join(named, "cid", "left").select("digest", F.coalesce("least", "name").alias("least"), "copies"), "near-named")
    out = salted_join(sets.select("doc_id", "key", "n", "digest"), component, ["digest"], "copies", "doc_id")
    component_id = F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component_id)
    if key_col is not None:
        kept = kept & ((F.col("n") == 0) | F.col("key").eqNullSafe(F.col("least.key")))
    extra = ["key"] if key_col is not None else []
    return out.select("doc_id", *extra, F.col("n").alias("n_shingles"), component_id.alias("component_id"), kept.alias("kept"))
