"""Runs of consecutive words that repeat with a period, by the linear tandem-repeat method.

A tandem repeat is a stretch of the form aa, a its root. Lempel-Ziv blocks give pairs
(start, root length) such that the leftmost tandem repeat of every kind follows from one
of them by rotation (Gusfield and Stoye's leftmost-covering set). From each pair a walk
goes along suffix links: drop the first word, go on by the same word. The places in the
suffix tree that the walks pass are the text's whole vocabulary of tandem repeats, each
taken once. All leaves below a place are its occurrences, and occurrences of one root
length at consecutive words merge into a run. The suffix tree is kept as a suffix array
with longest common prefixes; a place in it is an interval of that array and a depth.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vcspark.llm.textops import batches

LEAST_WORDS = 24
LEAST_EXPONENT = 3
#: Words of a stretch that any run of interest holds at least three times.
_GRAM = 8
#: Words of texts that share one suffix tree; a longer text has one of its own.
JOINT_WORDS = 16_384
_U = np.uint64


class SuffixTree:
    """Suffix array of a sequence of numbers, with answers on common extensions and places in the tree.

    ``ranks[l]`` numbers the stretches of length 2**l, in order, so two are equal when
    their numbers are.
    """

    def __init__(self, items: np.ndarray) -> None:
        n = self.n = len(items)
        rank = np.unique(items, return_inverse=True)[1].astype(np.int64)
        self.ranks: list[np.ndarray] = []
        width = 1
        while True:
            self.ranks.append(np.append(rank, -1).astype(np.int32))
            if n == 0 or rank.max(initial=0) == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.common = np.zeros(n + 1, np.int64)  # of the suffix at this place and the one before it
        if n > 1:
            self.common[1:n] = self.forward(self.order[1:], self.order[:-1])
        self._least = [self.common]
        while 1 << len(self._least) <= n + 1:
            last, step = self._least[-1], 1 << (len(self._least) - 1)
            self._least.append(np.minimum(last[:-step], last[step:]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items agree from ``i`` and from ``j`` on (different positions, at most n)."""
        i, j = np.array(i, np.int64), np.array(j, np.int64)
        total = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            step = ((rank[i] == rank[j]) & (i != j) & (i < self.n) & (j < self.n)).astype(np.int64) << level
            i += step
            j += step
            total += step
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items agree up to ``i`` and up to ``j``, both included (-1: none; different positions)."""
        i, j = np.array(i, np.int64) + 1, np.array(j, np.int64) + 1
        total = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.ranks[level], 1 << level
            a, b = i - width, j - width
            step = ((a >= 0) & (b >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << level
            i -= step
            j -= step
            total += step
        return total

    def earlier(self) -> np.ndarray:
        """For each position, how much of what follows also starts at an earlier one."""
        n = self.n
        below = [self.order]
        while 1 << len(below) <= n:
            last, step = below[-1], 1 << (len(below) - 1)
            below.append(np.minimum(last[:-step], last[step:]))
        position = np.arange(n)
        left, right = self.rank - 1, self.rank + 1  # the next place on either side with a smaller position
        for level in range(len(below) - 1, -1, -1):
            width, table = 1 << level, below[level]
            at = left - width + 1
            left = np.where((at >= 0) & (table[np.clip(at, 0, len(table) - 1)] > position), left - width, left)
            right = np.where((right + width <= n) & (table[np.clip(right, 0, len(table) - 1)] > position), right + width, right)
        out = np.zeros(n, np.int64)
        for side, there in ((left, left >= 0), (right, right < n)):
            out[there] = np.maximum(out[there], self.forward(position[there], self.order[side[there]]))
        return out

    def place(self, position: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the suffixes that share ``depth`` items with that at ``position``."""
        first, last = self.rank[position].copy(), self.rank[position].copy()
        for level in range(len(self._least) - 1, -1, -1):
            width, table = 1 << level, self._least[level]
            at = first - width + 1
            first = np.where((at >= 1) & (table[np.clip(at, 0, len(table) - 1)] >= depth), first - width, first)
            last = np.where((last + width < self.n) & (table[np.clip(last + 1, 0, len(table) - 1)] >= depth), last + width, last)
        return first, last


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, the numbers start[i], start[i] + 1, ... (count[i] of them), and the i each is of."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of], of


def _distinct(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of numbers from 0 to n, in order."""
    both = np.unique(a * (n + 1) + b)
    return both // (n + 1), both % (n + 1)


def covering_pairs(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) from which rotations to the right reach the leftmost tandem repeat of every kind.

    Each Lempel-Ziv block is joined with the next: tandem repeats whose first half ends in
    the block reach back from its end, or start before it and pass its start.
    """
    n, earlier = tree.n, tree.earlier().tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += max(1, earlier[at])
    edge = np.array([*starts, n, n], np.int64)
    h, h1, h2 = edge[:-2], edge[1:-1], edge[2:]
    inner, of = _spread(np.ones(len(h), np.int64), h1 - h)  # first half ends at the block's end or before
    end = h1[of]
    q = end - inner
    ahead, back = tree.forward(end, q), tree.backward(end - 1, q - 1)
    found = (ahead + back >= inner) & (ahead > 0)
    pairs = [(np.maximum(q - back, q - inner + 1)[found], inner[found])]
    outer, of = _spread(np.ones(len(h), np.int64), np.minimum(h2 - h, n - h))  # starts before the block
    begin = h[of]
    q = np.minimum(begin + outer, n)
    ahead, back = tree.forward(begin, q), tree.backward(begin - 1, q - 1)
    start = np.maximum(begin - back, begin - outer + 1)
    found = (ahead + back >= outer) & (ahead > 0) & (back > 0) & (start + outer <= h1[of])
    pairs.append((start[found], outer[found]))
    return _distinct(*[np.concatenate([p[k] for p in pairs]) for k in (0, 1)], n)


def _primitive(tree: SuffixTree, start: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether the root isn't itself a repetition; one that is belongs to a smaller period."""
    out = np.ones(len(root), bool)
    rest, p = root.copy(), 2
    while len(rest) and p * p <= rest.max(initial=1):
        for divisor in [np.flatnonzero(rest % p == 0)]:
            q = root[divisor] // p
            out[divisor] &= tree.forward(start[divisor], start[divisor] + q) < 2 * root[divisor] - q
            while len(divisor):
                rest[divisor] //= p
                divisor = divisor[rest[divisor] % p == 0]
        p += 1
    big = np.flatnonzero(rest > 1)
    q = root[big] // rest[big]
    out[big] &= tree.forward(start[big], start[big] + q) < 2 * root[big] - q
    return out


def runs_of(items: np.ndarray, least: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every stretch that can't be extended, by start, then period.

    Length is at least ``least`` and ``exponent`` (2 or more) periods.
    """
    n = len(items)
    if n < 2:
        return []
    tree = SuffixTree(items)
    start, root = covering_pairs(tree)
    plain = _primitive(tree, start, root)
    start, root = start[plain], root[plain]
    position, of = _spread(start, tree.forward(start, start + root) - root + 1)  # rotations that the suffix-link walk passes
    root, position = _distinct(root[of], position, n)
    first, last = tree.place(position, 2 * root)
    new = np.unique(root * (n + 1) + first, return_index=True)[1]  # the vocabulary: each place once
    leaf, of = _spread(first[new], last[new] - first[new] + 1)
    root, position = _distinct(root[new][of], tree.order[leaf], n)
    begin = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (position[1:] != position[:-1] + 1))[: len(root)])
    close = np.append(begin[1:], len(root))[: len(begin)] - 1
    start, period = position[begin], root[begin]
    length = position[close] - start + 2 * period
    kept = length >= np.maximum(least, exponent * period)
    return sorted(zip(start[kept].tolist(), length[kept].tolist(), period[kept].tolist()), key=lambda r: (r[0], r[2]))


def runs_of_each(texts: list[np.ndarray], least: int = 2, exponent: int = 2) -> list[list[tuple[int, int, int]]]:
    """``runs_of`` for several sequences at once: joined, with numbers of their own and a separator after each."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts, begin, used = [], [0], 0
    for items in texts:
        part = np.append(items, items.max(initial=-1) + 1) + used
        used = int(part[-1]) + 1
        parts.append(part)
        begin.append(begin[-1] + len(part))
    for start, length, period in runs_of(np.concatenate(parts), least, exponent) if parts else []:
        of = bisect_right(begin, start) - 1
        out[of].append((start - begin[of], length, period))
    return out


def may_repeat(items: np.ndarray) -> bool:
    """Whether some stretch of ``_GRAM`` words comes three times, as it does in every run of ``LEAST_WORDS`` words and three periods."""
    n = len(items) - _GRAM + 1
    if n < 3:
        return False
    gram, unit = items.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(0xD1B54A32D192ED03), 1
    while unit < _GRAM:
        gram = (gram[:-unit] ^ (gram[:-unit] >> _U(29))) * _U(0xBF58476D1CE4E5B9) + gram[unit:]
        unit *= 2
    gram.sort()
    return bool((gram[2:] == gram[:-2]).any())


def planted(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words with the repetition that the number's CRC-32 asks for in one document of ten."""
    h, n = zlib.crc32(b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for run in runs:  # in order of start, then period, so the first of equals stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    Words are runs of anything but space and U+0009..U+000D. A run has ``LEAST_WORDS``
    words and ``LEAST_EXPONENT`` periods at least. ``plant`` repeats words first, as
    ``planted`` says; a null id plants nothing. Null and empty texts have no words and
    no runs. Texts are read whole, each in the task that reads its row: memory is some
    300 bytes for each word of the longest text that repeats itself. Rows that repeat
    are looked at each for itself, other columns aren't read, and nothing is shuffled.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def described(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        if runs:
            change = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                change[start + period] += 1
                change[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
        best = _best(runs)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return doc_id, len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()

    def several(rows: pa.RecordBatch) -> Iterator[tuple]:
        """Texts without runs at once, the others as soon as they fill a joint tree."""
        waiting: list[tuple[int | None, list[bytes], np.ndarray]] = []
        size = 0
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text")):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            if plant and doc_id is not None:
                words = planted(words, doc_id)
            items = None
            if len(words) >= LEAST_WORDS:
                number: dict[bytes, int] = {}
                items = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            if items is None or not may_repeat(items):
                yield described(doc_id, words, [])
                continue
            waiting.append((doc_id, words, items))
            size += len(items)
            if size >= JOINT_WORDS:
                yield from map(described, *zip(*[w[:2] for w in waiting]), runs_of_each([w[2] for w in waiting], LEAST_WORDS, LEAST_EXPONENT))
                waiting, size = [], 0
        if waiting:
            yield from map(described, *zip(*[w[:2] for w in waiting]), runs_of_each([w[2] for w in waiting], LEAST_WORDS, LEAST_EXPONENT))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        for part in parts:
            for rows in batches(part, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*several(rows)), kinds)], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names))
