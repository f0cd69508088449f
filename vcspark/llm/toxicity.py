"""Toxicity of texts by a support vector machine with a gap-weighted subsequence kernel.

Two stretches of a sentence are alike as far as they share subsequences of ``ORDER``
symbols; a subsequence counts ``DECAY`` for each symbol that it skips and spans
``SPAN`` symbols at most. So a word with letters inserted or left out is still much like
itself. Training has labelled sentences only as parts of labelled documents: sentences
of clean documents are clean, and of a toxic document's, the stretches that stand out
most are taken as toxic, and taken anew after each fit. Stretches are mapped by the
Nystroem method: kernel values with landmarks, times the inverse root of the landmarks'
kernel matrix. What the machine found is linear in the landmarks' subsequences, so it
folds into one weight for each subsequence, a table of fixed size; a text is scored by
adding weights along it, without looking at landmarks again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vcspark.llm.textops import batches

ORDER = 4
SPAN = 6
DECAY = 0.6
#: Symbols: 26 letters, other letters by code point in five classes, everything else.
SYMBOLS = 32
_OTHER = 31
#: Starting points of subsequences that make up one stretch.
STRETCH = 10
LANDMARKS = 512
ROUNDS = 2
#: Bounds of the labelled sample: documents of each class, characters of one, and of all.
SAMPLE_DOCS = 1500
SAMPLE_DOC_CHARS = 65_536
SAMPLE_CHARS = 6_000_000
THRESHOLD = 0.7

_PATTERNS = [(p, DECAY ** (p[-1] + 1 - ORDER)) for p in combinations(range(1, SPAN), ORDER - 1)]


def _symbol_table() -> np.ndarray:
    """Symbols of the code points below 0x3000; from there on every one counts as a letter."""
    out = np.full(0x3000, _OTHER, np.uint8)
    for code in range(0x3000):
        low = chr(code).lower()[:1]
        if "a" <= low <= "z":
            out[code] = ord(low) - 97
        elif low.isalpha():
            out[code] = 26 + ord(low) % 5
    return out


_TABLE = _symbol_table()


@dataclass
class Symbols:
    """Texts as symbols; ``text`` and ``sentence`` say of which text and sentence each is."""

    code: np.ndarray
    text: np.ndarray
    sentence: np.ndarray


def symbols_of(texts: list[str | None]) -> Symbols:
    """Lower-cased letters; a run of anything else is one symbol, and none between letters that stand alone (spelled words).

    Sentences end at a full stop, question or exclamation mark before white space, and
    at line ends. Each begins and ends with the symbol of no letter.
    """
    joined = "\n".join(t.replace("\n", "\r") if t else "" for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(points < 0x3000, _TABLE[np.minimum(points, 0x2FFF)], 26 + (points % 5)).astype(np.uint8)
    text = np.append(0, np.cumsum(points == 10, dtype=np.int32)[:-1]).astype(np.int32)
    blank = (points == 10) | (points == 13) | (points == 32) | (points == 9)
    mark = np.isin(points, np.array([33, 46, 63], np.uint32))
    stop = (points == 10) | (points == 13) | (mark & np.append(blank[1:], True))
    sentence = np.append(0, np.cumsum(stop, dtype=np.int32)[:-1]).astype(np.int32)
    other = code == _OTHER
    edge = np.append(True, sentence[1:] != sentence[:-1])
    first = other & (edge | np.append(True, ~other[:-1]))  # of a run of no letters
    last = np.append(edge[1:], True)
    kept = ~other | first | last
    code, text, sentence, edge, last = code[kept], text[kept], sentence[kept], edge[kept], last[kept]
    other = code == _OTHER
    alone = ~other & np.append(True, other[:-1]) & np.append(other[1:], True)  # a letter between two that are none
    spelled = np.zeros(len(code), bool)
    spelled[1:-1] = other[1:-1] & alone[:-2] & alone[2:] & ~last[1:-1]
    keep = ~spelled
    return Symbols(code[keep], text[keep], sentence[keep])


def _features(code: np.ndarray, sentence: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: the subsequence at every symbol, whether it lies in one sentence, its weight."""
    n = len(code)
    padded = np.append(code, np.full(SPAN, _OTHER, np.uint8)).astype(np.int32)
    of = np.append(sentence, np.full(SPAN, -1, np.int32))
    inside = [of[d : d + n] == sentence for d in range(SPAN)]
    for offsets, weight in _PATTERNS:
        key = padded[:n]
        for d in offsets:
            key = key * SYMBOLS + padded[d : d + n]
        yield key, inside[offsets[-1]], weight


def _along(symbols: Symbols, weights: np.ndarray) -> np.ndarray:
    """The value of the stretch that starts at each symbol."""
    total = np.zeros(len(symbols.code), np.float64)
    for key, inside, weight in _features(symbols.code, symbols.sentence):
        total += np.where(inside, weights[key], 0) * weight
    summed = np.append(0, np.cumsum(total))
    n = len(total)
    starts = np.flatnonzero(np.append(True, symbols.sentence[1:] != symbols.sentence[:-1])) if n else np.zeros(0, np.int64)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) if n else starts
    return summed[np.minimum(np.arange(n) + STRETCH, end)] - summed[:n]


def _best_of(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted ``groups``: each one's number, largest value, and where it is."""
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(values, starts) if len(starts) else np.zeros(0)
    hit = np.flatnonzero(values == np.repeat(most, np.diff(np.append(starts, len(groups)))))
    place = hit[np.append(True, groups[hit][1:] != groups[hit][:-1])] if len(hit) else hit
    return groups[starts], most, place


def _signals(symbols: Symbols, weights: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts: its most toxic sentence, the next, and how many are on the toxic side."""
    out = np.tile(np.array([-2.0, -2.0, 0.0]), (n, 1))
    of, most, place = _best_of(_along(symbols, weights), symbols.sentence)
    text = symbols.text[place]
    most = np.clip(most, -2, 2)
    np.maximum.at(out[:, 0], text, most)
    order = np.lexsort((-most, text))
    second = np.append(False, (text[order][1:] == text[order][:-1])) & np.append([True, True], text[order][2:] != text[order][:-2])[: len(order)]
    out[text[order][second], 1] = most[order][second]
    out[:, 2] = np.log1p(np.bincount(text, most > 0, minlength=n)[:n])
    return out


def _stretches(symbols: Symbols, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (subsequences, weights) of the stretches at ``places``, one array row each, weight 0 outside the sentence."""
    n = len(symbols.code)
    span = places[:, None] + np.arange(STRETCH + SPAN)[None, :]
    there = span < n
    span = np.minimum(span, n - 1)
    code = np.where(there, symbols.code[span], _OTHER).astype(np.int32)
    same = there & (symbols.sentence[span] == symbols.sentence[places][:, None])
    keys, weights = [], []
    for offsets, weight in _PATTERNS:
        key = code[:, :STRETCH]
        for d in offsets:
            key = key * SYMBOLS + code[:, d : d + STRETCH]
        keys.append(key)
        weights.append(np.where(same[:, offsets[-1] : offsets[-1] + STRETCH], weight, 0).astype(np.float32))
    return np.concatenate(keys, axis=1), np.concatenate(weights, axis=1)


class _Landmarks:
    """Stretches that others are compared with, and the Nystroem map they give."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.index, inverse = np.unique(keys, return_inverse=True)
        m = len(keys)
        self.values = np.zeros((len(self.index) + 1, m), np.float32)  # the last row: subsequences of no landmark
        np.add.at(self.values, (inverse.reshape(keys.shape), np.arange(m)[:, None]), weights)
        own = self.kernel(keys, weights).astype(np.float64)
        value, vector = np.linalg.eigh((own + own.T) / 2)
        good = value > 1e-6 * max(value.max(initial=0), 1e-12)
        self.root = (vector[:, good] / np.sqrt(value[good])) @ vector[:, good].T

    def kernel(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), self.values.shape[1]), np.float32)
        for at in range(0, len(keys), 256):
            part = keys[at : at + 256]
            place = np.minimum(np.searchsorted(self.index, part), len(self.index) - 1)
            place = np.where(self.index[place] == part, place, len(self.index))
            out[at : at + 256] = np.einsum("ns,nsm->nm", weights[at : at + 256], self.values[place])
        return out

    def mapped(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.kernel(keys, weights) @ self.root

    def folded(self, normal: np.ndarray) -> np.ndarray:
        """The machine as one weight for each subsequence."""
        out = np.zeros(SYMBOLS**ORDER, np.float32)
        out[self.index] = self.values[:-1] @ (self.root @ normal)
        return out


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, classes of equal weight, no offset: Newton steps."""
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * len(y) / 2 * cost
    w = np.zeros(x.shape[1])
    for _ in range(20):
        active = y * (x @ w) < 1
        xa, ca = x[active], share[active]
        new = np.linalg.solve(np.eye(len(w)) + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            return new
        w = new
    return w


def _first_weights(symbols: Symbols, toxic: np.ndarray) -> np.ndarray:
    """Log odds of unbroken subsequences that more toxic than clean documents hold."""
    size = SYMBOLS**ORDER
    key, inside, _ = next(f for f in _features(symbols.code, symbols.sentence))
    pair = np.unique(symbols.text[inside].astype(np.int64) * size + key[inside])
    of, key = pair // size, pair % size
    held = [np.bincount(key[toxic[of] == side], minlength=size) for side in (True, False)]
    yes, no = max(1, toxic.sum()), max(1, (~toxic).sum())
    odds = np.log((held[0] + 0.5) / yes) - np.log((held[1] + 0.5) / no)
    return np.where((odds > np.log(3)) & (held[0] >= max(2, 0.005 * yes)), odds, 0).astype(np.float32)


def _calibrated(signals: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression, the constant last."""
    x = np.append(signals, np.ones((len(signals), 1)), axis=1)
    y, w = toxic.astype(float), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """``weights`` by subsequence (none: nothing was learned) and how signals make a score."""

    weights: np.ndarray | None
    logistic: np.ndarray
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = _signals(symbols_of(texts), self.weights, len(texts))
        return 1 / (1 + np.exp(-np.clip(np.append(x, np.ones((len(x), 1)), axis=1) @ self.logistic, -30, 30)))


def fit(texts: list[str | None], toxic: list[int], seed: int = 7) -> Model:
    """Learn from whole texts; a fourth of them, by position, is kept for turning signals into scores."""
    y = np.array(toxic, dtype=bool)
    apart = np.arange(len(y)) % 4 == 3
    prior = float(y.mean()) if len(y) else 0.0
    if not (y & ~apart).any() or not (~y & ~apart).any():
        return Model(None, np.zeros(4), min(prior, 0.5))
    rng = np.random.default_rng(seed)
    own = np.flatnonzero(~apart)
    symbols, label = symbols_of([texts[i] for i in own]), y[own]
    weights = _first_weights(symbols, label)
    for turn in range(ROUNDS):
        _, most, place = _best_of(_along(symbols, weights), symbols.sentence)
        text = symbols.text[place]
        order = np.lexsort((-most, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        top = np.empty(len(order), np.int64)
        top[order] = rank
        clean = most[~label[text]]
        bar = np.quantile(clean, 0.999) if turn else np.quantile(clean, 0.99)
        yes = place[label[text] & (top < 8) & ((top == 0) | (most > bar))]
        hard = place[~label[text] & (top < 4)]
        some = rng.choice(np.flatnonzero(~label[symbols.text]), size=min(4000, len(symbols.code)))
        no = np.unique(np.concatenate([rng.permutation(hard)[:6000], some]))
        yes = rng.permutation(yes)[:6000]
        half = LANDMARKS // 2
        marks = np.unique(np.concatenate([yes[:half], rng.permutation(no)[:half]]))
        nystroem = _Landmarks(*_stretches(symbols, marks))
        x = np.concatenate([nystroem.mapped(*_stretches(symbols, yes)), nystroem.mapped(*_stretches(symbols, no))])
        weights = nystroem.folded(_machine(x, np.append(np.ones(len(yes)), -np.ones(len(no)))))
    test = np.flatnonzero(apart)
    if not y[test].any() or y[test].all():
        test = np.arange(len(y))
    signals, label = _signals(symbols_of([texts[i] for i in test]), weights, len(test)), y[test]
    alone = signals[label].copy()  # one toxic sentence among clean ones is enough
    alone[:, 1] = rng.choice(signals[~label, 1], size=len(alone))
    alone[:, 2] = np.log1p(alone[:, 0] > 0)
    return Model(weights, _calibrated(np.concatenate([signals, alone]), np.append(label, np.ones(len(alone), bool))), prior)


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; those with 1 are held out."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Whole texts and labels to learn from: at most ``SAMPLE_DOCS`` of each class and ``SAMPLE_CHARS`` characters, by hash.

    Only ids that aren't held out and have one label take part, and texts of up to
    ``SAMPLE_DOC_CHARS`` characters. Only the ids chosen are sent to the documents.
    """
    one = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    one = one.where(remainder("id") != 1).groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least")).where("toxic = least").select("id", "toxic", F.xxhash64("id").alias("h"))
    parts = [one.where(F.col("toxic") == side).orderBy("h", "id").limit(2 * SAMPLE_DOCS) for side in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most 4 * SAMPLE_DOCS rows of three numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text").between(1, SAMPLE_DOC_CHARS))
    found = texts.join(chosen, "id")
    by_class = [found.where(F.col("toxic") == side).orderBy("h", "id", F.xxhash64("text")).limit(SAMPLE_DOCS) for side in (0, 1)]
    out_texts: list[str] = []
    out_labels: list[int] = []
    for side, part in enumerate(by_class):
        chars = 0
        for text in part.select("text").toLocalIterator():
            chars += len(text[0])
            if chars > SAMPLE_CHARS // 2:
                break
            out_texts.append(text[0])
            out_labels.append(side)
    return out_texts, out_labels


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD`` on).

    Learns from a bounded sample of the labelled texts that aren't held out (see
    ``labelled_sample``); scores every whole text. Null and empty texts score like texts
    without any toxic stretch; a null id isn't held out. Rows that repeat are scored each
    for itself. Only id and text are read; without labels of both kinds every score is
    the sample's share of toxic texts, half at most. The table of weights that tasks get
    has 32**4 entries at every size.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, id_col, text_col, label_col)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in batches(part, "text", 1 << 20):
                score = model.value.scores(rows.column("text").to_pylist())
                columns = [rows.column("doc_id"), rows.column("held_out"), pa.array(score, pa.float64()), pa.array(score >= THRESHOLD).cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(id_col) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
