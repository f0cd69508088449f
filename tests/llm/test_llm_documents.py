"""Operators on documents against brute force, on all of a small table and on edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vcspark.llm import fuse_filter, near_dedup, queries
from vcspark.llm.components import connected_components
from vcspark.llm.exact_dedup import add_batch, exact_dedup
from vcspark.llm.langid import UND, identify_documents, identify_pages
from vcspark.llm.lm_scoring import score_documents
from vcspark.llm.mixing import mix_sources, source_targets
from vcspark.llm.near_dedup import near_duplicates
from vcspark.llm.packing import assemble, best_fit, cut_pieces, pack, pack_documents
from vcspark.llm.textops import mix, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, shard int, h long, n long"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "word", "fr", "a"), (5, " ".join(WORDS), "en", "b"), (6, " ".join(WORDS), "en", "b"),
    (6, " ".join(WORDS), "en", "b"), (7, "  ".join(WORDS) + "\n", "en", "c"), (8, " ".join(WORDS[:-1] + ["OTHER"]), None, "c"), (9, "word " * 60_000, "de", "hot"),
    (10, "Ünïcödé \u00a0 text\u2003here", "de", "hot"), (None, "word", "en", "a"), (None, None, None, None), (11, "OTHER words altogether", "xx", ""), (12, "x" * 200_000, "en", "b"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, 1, 5, True, 2, 3, 4) for r in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


OPERATORS = {
    "mix": (mix_sources, lambda r: len(words(r[1]))),
    "exact": (exact_dedup, None),
    "near": (near_duplicates, None),
    "lm": (score_documents, None),
    "pack": (pack_documents, None),
    "language": (identify_documents, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name][0](empty).collect() == []


@pytest.mark.parametrize("name", ["mix", "exact", "near", "lm", "language"])
def test_a_row_for_each_row(edges, name):
    assert Counter(r.doc_id for r in OPERATORS[name][0](edges).collect()) == Counter(r[0] for r in EDGES)


# mixing


def test_targets_are_shared_by_weight_below_the_cap(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 500), (3, "c", 490), (4, None, 0)], "doc_id long, source string, size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    # a (weight 5) stops at 30; b and c share 970 as 2 : 1; null (weight 5) has nothing
    assert got["a"] == 30 and got["b"] == pytest.approx(970 * 2 / 3) and got["c"] == pytest.approx(970 / 3) and got[None] == 0


def test_mix_meets_targets(spark):
    got = queries.op1_mix_sources(spark, SF).collect()
    again = queries.op1_mix_sources(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(sum(r.size for r in got))
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1


def test_mix_takes_a_document_target_over_size_times_on_average(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 4 == 0]) for i in range(400)], "doc_id long, text string, source string")
    runs = [mix_sources(docs, seed=s).collect() for s in range(3)]
    for rows in runs:
        for source in "ab":
            rs = [r for r in rows if r.source == source]
            share = sum(r.taken for r in rs) / rs[0].target
            assert abs(share - 1) < 0.02
            assert len({r.copies for r in rs}) <= 2


# exact dedup


def exact_rows(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[normalised(text)].append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[normalised(text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(normalised(text).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_dedup_equals_brute_force(edges, batches):
    got = sorted(map(tuple, exact_dedup(edges, batches=batches).collect()), key=repr)
    assert got == exact_rows(EDGES)


def test_exact_dedup_of_documents(spark, documents):
    assert sorted(map(tuple, queries.op2_exact_dedup(spark, SF).collect()), key=repr) == exact_rows(documents)


def test_differing_texts_under_one_digest_stop_the_run(spark):
    group = spark.createDataFrame([(bytearray(hashlib.sha256(b"a").digest()), 1, 1)], "sha binary, keep_id long, size long")
    other = group.withColumn("keep_id", F.lit(2).cast("long"))
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.raises(Exception, match="share a SHA-256"):
        add_batch(group, other, texts).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_fuse_filter_holds_every_key_and_few_others(n):
    keys = mix(np.arange(n, dtype=np.uint64))
    data = fuse_filter.build(keys)
    assert fuse_filter.contains(data, keys).all()
    others = mix(np.arange(10**6, 10**6 + 100_000, dtype=np.uint64))
    assert fuse_filter.contains(data, others).mean() < 0.001
    assert n < 1000 or len(data) < 3 * n


# near dedup


def shingle_set(text, width):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_rows(rows, width, percent=80):
    sets = [shingle_set(r[1], width) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)] if sets[i] else r[0], (least[find(i)] if sets[i] else r[0]) == r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_of_documents_equal_brute_force(spark, documents, width):
    got = near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), width=width).collect()
    assert sorted(map(tuple, got)) == near_rows(documents, width)


def near_copies(groups=12, size=25, length=150):
    """Groups of copies that differ in up to a tenth of their words, so that similarities lie on both sides of the limit."""
    rng = np.random.default_rng(3)
    rows, shared = [], [f"s{i}" for i in range(40)]
    for g in range(groups):
        base = [f"w{g}_{i}" for i in range(length)]
        for _ in range(size):
            copy = list(base)
            for i in rng.integers(0, length, rng.integers(0, length // 10)):
                copy[i] = f"x{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(copy + shared), "en", "a"))
    order = rng.permutation(len(rows))
    return [(int(i), *rows[j][1:]) for i, j in enumerate(order)]


def test_near_copies_equal_brute_force(spark):
    rows = near_copies() + [(10_000 + i, " ".join(WORDS[:i]), None, None) for i in range(6)] + [(20_000, None, None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), width=2).collect()
    assert sorted(map(tuple, got)) == near_rows(rows, 2)


def test_near_copies_over_many_blocks_equal_brute_force(spark, monkeypatch):
    """Lists and groups far larger than a block, most of whose members no first block joins."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = near_copies(groups=4, size=60)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), width=2).collect()
    assert sorted(map(tuple, got)) == near_rows(rows, 2)


OTHER_TEXTS = [[" ".join(f"{t}{i}" for i in range(40))] for t in ("p", "q", "r", "s")]


@pytest.mark.parametrize("other", range(4))
def test_near_links_of_an_id_with_two_texts_and_of_null_ids(spark, other):
    """Whichever of an id's texts has the smaller digest, and without any id, links are found."""
    text = [f"w{i}" for i in range(60)]
    changed = " ".join([*text[:59], "changed"])
    rows = [(3, OTHER_TEXTS[other][0]), (3, " ".join(text)), (7, changed), (None, " ".join(f"n{i}" for i in range(60))), (9, " ".join([*(f"n{i}" for i in range(59)), "x"])), (None, "alone in the world"), (None, "ALONE in the  world")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(3, 3, True), (3, 3, True), (7, 3, False), (None, 9, False), (9, 9, True), (None, None, True), (None, None, True)])
    by_key = near_duplicates(spark.createDataFrame([(*r, bytearray([i])) for i, r in enumerate(rows)], "doc_id long, text string, k binary"), width=2, key_col="k").collect()
    # (id, key) names a document: of the last two, which are equal, the smaller key stays
    assert sorted((r.key[0], r.kept) for r in by_key) == [(0, True), (1, True), (2, False), (3, False), (4, True), (5, True), (6, False)]


def test_near_edges(edges):
    got = {r.doc_id: r for r in near_duplicates(edges, width=2).collect() if r.doc_id is not None}
    assert {got[i].component_id for i in (5, 6, 7, 8)} == {5} and got[5].kept and not got[8].kept
    assert got[4].component_id == 4 and got[4].n_shingles == 1 and got[9].n_shingles == 1
    assert all(got[i].kept and got[i].n_shingles == 0 for i in (1, 2, 3))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(100, 101), (5, 5), (None, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 71)}, 100: 100, 101: 100}


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["a b", "b a", "ab", "", None, "A\tB\n", "\u00a0 c", "y" * 100_000 + " a"]
    hashes, counts = word_hashes(pa.array(texts))
    assert counts.tolist() == [2, 2, 1, 0, 0, 2, 2, 2]
    assert (hashes[:2] == hashes[[3, 2]]).all() and (hashes[5:7] == hashes[:2]).all() and hashes[-1] == hashes[0]
    assert len(set(hashes.tolist())) == 6


# language-model scoring


def lm_rows(rows, backoff=0.4):
    micro = lambda x: round(math.log(x) * 1e6)
    texts = [words(lower(r[1])) for r in rows]
    one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    total = sum(one.values())
    out = {}
    for (doc_id, *_), t in zip(rows, texts):
        own1, own2, score, seen = Counter(t), Counter(zip(t, t[1:])), 0, 0
        for i, w in enumerate(t):
            rest = micro(max(total - len(t), 1))
            c2, pair = one[w] - own1[w], (t[i - 1], w)
            if i and two[pair] - own2[pair] > 0:
                score += micro(two[pair] - own2[pair]) - micro(one[t[i - 1]] - own1[t[i - 1]])
                seen += 1
            else:
                score += (micro(backoff) if i else 0) + (micro(c2) if c2 > 0 else micro(backoff)) - rest
        out[doc_id] = (len(t), seen, score / 1e6)
    return out


def test_scores_equal_brute_force(spark, documents):
    got = {r.doc_id: r for r in queries.op3_lm_score(spark, SF).collect()}
    want = lm_rows(documents)
    assert got.keys() == want.keys()
    for i, (n, seen, score) in want.items():
        assert (got[i].words, got[i].seen) == (n, seen) and got[i].log_score == pytest.approx(score, abs=2e-6 * max(n, 1))


@pytest.mark.parametrize("frequent,top,bucket,batch,bits", [(60, 5, 500, 3000, 1 << 20), (0, 0, 10**6, 1 << 20, 1 << 12), (1 << 20, 2, 300, 1, 64), (40, 4, 2000, 1 << 20, 100)])
def test_scores_are_the_same_by_every_path(spark, documents, monkeypatch, frequent, top, bucket, batch, bits):
    """Small tables, so that most words and bigrams come by shuffled rows, many buckets, small batches; null and repeated ids."""
    from vcspark.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scoring, "TOP", top)
    monkeypatch.setattr(lm_scoring, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(lm_scoring, "_BATCH", batch)
    monkeypatch.setattr(lm_scoring, "FILTER_BITS", bits)
    texts = [d[1] for d in documents[:60]] + [documents[3][1], documents[3][1], "a a a a b", "A b a  b", "once", "", None, "\u00a0 x", "a", "only here twice only here"]
    ids = [None, 7, None, 7, 2**53 + 1, 2**53, -5, None]
    rows = [(ids[i] if i < len(ids) else i + 100, t) for i, t in enumerate(texts)]
    want: dict = {}
    for (_, n, seen, score), (doc_id, _) in zip([(k, *v) for k, v in lm_rows([(i, t) for i, (_, t) in enumerate(rows)]).items()], rows):
        a, b, c, m = want.get(doc_id, (0, 0, 0.0, 0))
        want[doc_id] = (a + n, b + seen, c + score, m + 1)
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == {k: v[3] for k, v in want.items()}
    repeated = {7, None}
    for r in got:
        n, seen, score, _ = want[r.doc_id]
        assert r.words == n and r.seen == seen
        if r.doc_id not in repeated:  # a repeated id's words outside of it are taken for all its rows together
            assert r.log_score == pytest.approx(score, abs=2e-6 * max(n, 1))
        assert r.mean_log_score == (pytest.approx(r.log_score / n) if n else None)


def test_the_filter_holds_its_words(spark):
    from vcspark.llm import lm_scoring

    words = np.random.default_rng(5).integers(-(2**63), 2**63, 3000)
    filled = lm_scoring.word_filter(spark.createDataFrame([(int(w),) for w in words[:1000]], "word long").repartition(3))
    found = lm_scoring._maybe(words.view(np.uint64), filled)
    assert found[:1000].all() and found[1000:].sum() < 5
    assert not lm_scoring.word_filter(spark.createDataFrame([], "word long")).any()


def test_score_of_no_rows(empty):
    assert score_documents(empty).count() == 0


def test_score_edges(edges):
    got = [r for r in score_documents(edges).collect()]
    assert all((r.words, r.log_score, r.mean_log_score) == (0, 0.0, None) for r in got if r.doc_id in (1, 2, 3))
    assert next(r for r in got if r.doc_id == 9).words == 60_000


# language identification


def test_language_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_documents(docs).where("length(text) > 60").select("lang", "detected_lang").collect()
    assert sum(r.lang == r.detected_lang for r in got) / len(got) > 0.85


def test_held_out_documents_keep_their_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).withColumn("true", F.col("lang"))
    known = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in identify_documents(hidden).where("lang is null").collect()]
    assert sum(known[r.doc_id] == r.detected_lang for r in got) / len(got) > 0.85


def test_language_edges(edges):
    got = {r.doc_id: r for r in identify_documents(edges).collect()}
    assert all(got[i].detected_lang == UND and got[i].detected_prob == 1.0 for i in (1, 2, 3))
    assert "kept" in got[4].asDict()


def test_language_of_pages(spark):
    got = queries.op5_language_id(spark, SF).collect()
    assert len(got) == 50 and sum(r.lang == r.declared for r in got if r.declared) / len(got) > 0.7
    assert all(0 < r.prob <= 1 for r in got)


def test_pages_without_anything(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no address", ""), (None, "http://a.de/x", "<html lang=de><p>1 2 3")], "page_id long, url string, html string")
    got = {r.page_id: r for r in identify_pages(pages).collect()}
    assert [got[i].lang for i in (1, 2, None)] == [UND] * 3 and got[1].host == "" and got[None].suffix == "de"


# packing


def test_pieces_hold_every_id_once_and_windows_have_no_gap(spark, documents):
    from tokenizers import Tokenizer

    from vcspark.llm.packing import byte_bpe_path

    library = Tokenizer.from_file(byte_bpe_path())
    library.encode_special_tokens = True
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in queries.op6_pack(spark, SF).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc_id, text, *_ in documents:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in windows.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    used = sum(r.length for rs in windows.values() for r in rs)
    assert len(windows) <= -(-used // 1024) + 2


def test_special_strings_and_odd_spaces_are_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    from vcspark.llm.packing import byte_bpe_path
    from vcspark.llm.tokens import Encoder

    library, own = Tokenizer.from_file(byte_bpe_path()), Encoder(byte_bpe_path())
    for text in ["", " ", "a  b", "don't stop 12 ,, x", "a <|endoftext|> b", "\u4f60\u597d w\u00f6rter", "tab\tand\nline ", "I'll we've", "x" * 3000, "\u20ac5 \u00bd"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = sorted(rng.integers(1, 65, rng.integers(0, 120)).tolist(), reverse=True)
        numbers, offsets = best_fit(lengths, 64)
        room = []
        for length, number, offset in zip(lengths, numbers, offsets):
            tight = min((r for r in room if r >= length), default=None)
            if number == len(room):
                assert tight is None
                room.append(64)
            else:
                assert room[number] == tight
            assert offset == 64 - room[number]
            room[number] -= length


def test_pack_edges_and_padding(edges):
    rows = pack_documents(edges).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in EDGES}
    assert all(r.length == r.doc_tokens == 1 for r in rows if r.doc_id in (1, 2))
    made = assemble(pack(cut_pieces(edges, keep_ids=True))).collect()
    assert all(len(r.ids) == (r.used if r.used.bit_count() == 1 else 1024) for r in made)


def test_pack_keeps_large_ids_beside_null_ones(spark):
    ids = [None, 2**53 + 1, 2**60 + 7, 5, None]
    docs = spark.createDataFrame([(i, "some words here", "x") for i in ids], "doc_id long, text string, `my col` string")
    got = pack_documents(docs).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(ids, key=repr)
    used = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b[1] == a[1] + a[2] for a, b in zip(used, used[1:]))
    assert pack(cut_pieces(docs, keep_ids=True).withColumn("my col", F.lit(1)), 1024).count() == 5
