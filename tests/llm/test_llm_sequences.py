"""Toxicity, periodic runs and the conversation trie against held-out labels and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from vcspark.llm import queries, tandem, toxicity
from vcspark.llm.prefix_trie import conversation_trie
from vcspark.llm.tandem import may_repeat, periodic_runs, planted, runs_of, runs_of_each
from vcspark.llm.toxicity import fit, score_toxicity, symbols_of

SF = "/root/testdata/sf0.001"
WORDS = r"[^\x20\x09-\x0D]+"


def slow_runs(items, least, exponent):
    """All periods, all starts; a stretch is left out if a divisor of its period fits it too."""
    n, out = len(items), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and items[j] == items[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.append((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted((r for r in out if not any(s <= r[0] and s + m >= r[0] + r[1] and q < r[2] and r[2] % q == 0 for s, m, q in out)), key=lambda r: (r[0], r[2]))


def made_items(rng):
    n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
    items = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.5 and n > 5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 9)
        items = items[:a] + [items[a + (i - a) % p] for i in range(a, n)]
    return np.array(items, np.int64)


def test_runs_equal_brute_force():
    rng = random.Random(4)
    several = [made_items(rng) for _ in range(1500)]
    for items in several:
        assert runs_of(items) == slow_runs(items, 2, 2)
        long = slow_runs(items, 24, 3)
        assert runs_of(items, 24, 3) == long
        assert may_repeat(items) or not long
    assert runs_of_each(several) == [slow_runs(items, 2, 2) for items in several]


def described(doc_id, text):
    words = re.findall(WORDS, text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = slow_runs([number[w] for w in words], 24, 3)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return doc_id, len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()


def test_periodic_runs_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "array_join(slice(split(text, ' '), 1, 600), ' ') as text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(tuple(r) for r in periodic_runs(docs).collect())
    assert got == sorted(described(*r) for r in rows)
    assert any(r[1] for r in got)


def test_periodic_runs_edges(spark, monkeypatch):
    monkeypatch.setattr(tandem, "JOINT_WORDS", 40)
    line = "one two three four five six seven eight\n"
    rows = [(None, None), (None, "a " * 30), (1, ""), (2, " \t\n "), (3, line * 3), (3, line * 3), (4, line * 2), (2**60 + 7, "x " * 24), (5, "y " * 23), (6, "é z " * 30 + line * 4), (7, "ab cd " * 5000 + line * 3)]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n_runs int, start string")
    got = sorted((tuple(r) for r in periodic_runs(docs).collect()), key=repr)
    assert got == sorted((described(*r) for r in rows), key=repr)
    assert periodic_runs(docs.limit(0)).count() == 0
    assert planted([], 0) == []


CONV = "conv_id long, turn long, role string, text string"


def slow_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    plain = {c: [k[3:] for k in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(plain.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    saved, leaves, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(WORDS, k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in kids[k])
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if rebuilt[c] == k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(df, **more):
    return sorted((tuple(r) for r in conversation_trie(df, **more).collect()), key=repr)


def made_conversations():
    rng = random.Random(3)
    rows = [(None, 1, "u", "x"), (None, None, None, None)]
    for c in [*range(90), -3, -25, -20, 205]:
        if c not in (40, 65):
            rows += [(c, rng.choice([t, t, t, None, 3]), rng.choice(["u", "a", None]), rng.choice(["a b", "c", None, "", " d e  f"])) for t in range(rng.randint(1, 9))]
    return rows


def test_trie_equals_brute_force(spark):
    rows = made_conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONV + ", conv long, depth string")
    assert trie(df) == slow_trie(rows)
    assert trie(spark.createDataFrame([], CONV)) == []


@pytest.mark.parametrize("band", [4, 10])
def test_trie_of_long_conversations_in_bands(spark, band):
    """Conversations over several bands, equal ones and some of other families among them, and ends at a band's last place."""
    rows = made_conversations() + [(c, t, "u", f"w {t % 7}") for c in (0, 1, 7, 100, 101, 300) for t in range(20 if c == 300 else 33)]
    assert trie(spark.createDataFrame(rows, CONV), band=band) == slow_trie(rows)


def test_trie_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op13_prefix_trie']})").fetchall()
    got = queries.QUERIES["op13_prefix_trie"](spark, SF).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def spoken(symbols):
    return "".join(chr(97 + c) if c < 26 else "#" if c < 31 else "_" for c in symbols.code)


def test_symbols():
    assert spoken(symbols_of(["You ARE 7 é i.d i o-t.  Next!\nEnd"])) == "you_are_#idiot__next__end_"
    got = symbols_of(["a b", None, "", "C. D", "x.y"])
    assert spoken(got) == "ab___c__d_xy_"
    assert sorted(set(got.text.tolist())) == [0, 1, 2, 3, 4]


@pytest.fixture(scope="module")
def model():
    """A model of two insults among made-up syllables, one of them only ever beside the other kind of word."""
    rng = random.Random(1)
    syllables = "ba ti mo re lu sen tar ik od an".split()

    def sentence():
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(9)) + "."

    def text(insults):
        parts = [sentence() for _ in range(6)]
        for w in insults:
            at = rng.randrange(6)
            parts[at] = parts[at][:-1] + f" {w} " + sentence()
        return " ".join(parts)

    labels = [int(i % 3 == 0) for i in range(300)]
    texts = [text(rng.choices(["glorkwump", "fizzbratch"], k=2) if y else []) for y in labels]
    return fit(texts, labels), text


def test_toxicity_tolerates_inserted_and_spelled_insults(model):
    fitted, text = model
    clean = fitted.scores([text([]) for _ in range(100)])
    assert (clean < 0.7).mean() >= 0.98
    for insult in ("glorkwump", "GLORKWUMP", "g.l.o.r.k.w.u.m.p", "g l o r k w u m p", "glorkwuump"):
        assert (fitted.scores([text([insult, insult]) for _ in range(40)]) >= 0.7).mean() >= 0.9, insult
    for insult in ("glorkxwump", "glork-wump", "gl*orkwump", "fizzybratch"):  # nearer the line, but clear of clean texts
        assert (fitted.scores([text([insult, insult]) for _ in range(40)])[:, None] > clean[None, :]).mean() >= 0.97, insult


def test_toxicity_scores_whole_texts_and_edges(model):
    fitted, text = model
    long = " ".join(text([]) for _ in range(10))
    low, high = fitted.scores([long, long + " glorkwump. fizzbratch. glorkwump."])
    assert low < 0.7 <= high
    edges = fitted.scores([None, "", "   ", "?!", "a", "\ud800"[:0] + "\U0001f600" * 50, "glorkwump"])
    assert ((edges >= 0) & (edges <= 1)).all() and len(set(edges[:3])) == 1
    one_by_one = [fitted.scores([t])[0] for t in [long, "glorkwump", None]]
    assert np.allclose(one_by_one, fitted.scores([long, "glorkwump", None]))


def test_toxicity_query_on_held_out_rows(spark):
    """Held-out accuracy, on the table with enough labels to learn from."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi").cache()
    got = score_toxicity(some, labels).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert len(got) == some.count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    held = got[got["held_out"]]
    rank = held["score"].rank()
    yes = held["toxic"] == 1
    auc = (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())
    assert auc > 0.9
    assert (held["predicted"] == held["toxic"]).mean() > 0.95


def test_toxicity_learns_from_training_rows_only(spark):
    """Labels of held-out rows, turned around, change nothing; neither do other columns of ``docs``."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.remainder("doc_id") == 1, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (sorted(tuple(r) for r in score_toxicity(docs.drop(*gone), table).collect()) for table, gone in ((labels, []), (turned, ["lang", "source", "n_chars"])))
    assert a == b


def test_toxicity_edges(spark):
    rows = [(None, None, "x"), (1, None, "x"), (1, "", "x"), (2, "fine words here", "x"), (2, "fine words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score_toxicity(docs, none).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.0}
    odd = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (2, 5)], "doc_id long, toxic int")
    assert score_toxicity(docs, odd).count() == 5
    assert score_toxicity(docs.limit(0), odd).count() == 0


def test_word_memo_stays_small():
    """A worker's memo held half a million words, about a hundred MB that stayed with an idle worker; ids don't depend on it."""
    from vcspark.llm.packing import byte_bpe_path
    from vcspark.llm.tokens import Encoder

    encoder = Encoder(byte_bpe_path())
    words = [f"w{i:x}" for i in range(240_000)]
    for at in range(0, len(words), 1000):
        text = " ".join(words[at : at + 1000])
        got = encoder.encode(text)
        assert len(encoder.memo) <= (1 << 17) + 1000
    assert got == b"".join(i.to_bytes(4, "little") for i in encoder.library.encode(text, add_special_tokens=False).ids)
