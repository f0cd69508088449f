"""Work that must not grow faster than the rows: what is worked out once a row, and what moves."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vcspark import plans
from vcspark.operators import dedup, ingest, skew
from vcspark.sources.shared import save_shared

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["section_rows", "extraction_rows", "recommendation_rows"])
def test_documents_are_parsed_once_a_row(spark, name):
    """Neither the fields nor the filter repeat the document that they are read from: it was parsed up to forty times a row."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("parse_json") + plan.count("parseJson") <= 2


def test_vectors_are_sent_to_few_blocks_however_many_there_are(spark, monkeypatch):
    """Blocks grow with the table, so copies of a row don't; 400 rows in blocks of at least four made over a hundred blocks. All pairs stay."""
    made = {}
    save = dedup.save_shared
    monkeypatch.setattr(dedup, "save_shared", lambda df, name: made.setdefault(name, save(df, name)))
    monkeypatch.setattr(dedup, "VECTOR_BLOCK", 4)
    monkeypatch.setattr(dedup, "VECTOR_CHUNK", 9)
    v = np.random.default_rng(3).normal(size=(400, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.left_id, r.right_id) for r in dedup.near_vector_pairs(df, df, 0.7).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert got == set(zip(*(x.tolist() for x in np.nonzero(unit @ unit.T >= 0.7))))
    cells = made["vector-blocks"].collect()
    assert sum(r.na for r in cells) <= dedup.VECTOR_BLOCKS + len(cells)


def _outcomes_of(spark, rows, catalogue):
    placed = spark.createDataFrame(rows, "seq long, hash binary, price double, n int, made int, ref long")
    return ingest._outcomes(placed, spark.createDataFrame(catalogue, "id long, content_hash string, price double"))


def test_listings_are_shuffled_once_to_be_compared(spark):
    """A listing moved four times to be compared with the one before it; products of few listings need one move."""
    plan = _outcomes_of(spark, [(1, b"a", 1.0, 0, 0, 5)], [(5, "a", 1.0)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Window") == 1


def test_long_products_are_compared_in_chunks_alike(spark, monkeypatch):
    """Products of many listings, of the catalogue and of the batch, beside short ones and duplicates, by chunks or not."""
    digest = lambda t: None if t is None else hashlib.md5(t.encode()).digest()
    rng = random.Random(5)
    rows = [(s, digest(rng.choice(["a", "b", None])), rng.choice([1.0, 2.0, None]), rng.choice([0, 1, 1, 2]), *rng.choice([(0, 7), (0, 7), (0, 8), (1, 0), (0, 9)])) for s in range(1, 200)]
    rows.append((0, digest("a"), 1.0, -1, 1, 0))
    catalogue = [(7, "a", 1.0), (8, None, None), (9, "b", 2.0), (10, "a", 1.0)]
    last, want = {(0, i): (digest(h), p) for i, h, p in catalogue}, set()
    for s, h, p, n, made, ref in sorted(rows):
        if n > 1:
            want.add((s, "duplicate", False))
            continue
        was = last.get((made, ref), (None, None))
        action = "new" if n < 0 else "unchanged" if was[0] == h else "changed"
        want.add((s, action, p is not None and (action == "new" or action == "changed" and was[1] != p)))
        last[made, ref] = (h, p)
    for chunk in (65_536, 40, 3):
        monkeypatch.setattr(ingest, "_CHUNK", chunk)
        got = [(r.seq, r.action, r.price_point) for r in _outcomes_of(spark, rows, catalogue).collect()]
        assert len(got) == len(rows) and set(got) == want


def test_search_terms_are_looked_up_by_one_key(spark):
    """A text was trimmed and lower-cased again for each of the terms it was held against, some ninety times a row."""
    plan = plans.QUERIES["item_search_queries"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(lower(") <= 4


def test_joins_with_small_tables_move_no_row(spark):
    """The rows moved once and the heaviest keys were sorted twice, however few keys there were."""
    left = spark.createDataFrame([(i, None if i % 7 == 0 else f"k{i % 5}") for i in range(300)], "id long, k string")
    keyed = save_shared(left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")), "test-keyed")
    joined = skew.salted_join(left, keyed, ["k"], "n", "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "TakeOrdered" not in plan
    want = {k: (n, f) for k, n, f in keyed.collect()}
    got = joined.collect()
    assert len(got) == 300 and all((r["n"], r["first"]) == want[r["k"]] for r in got)


@pytest.mark.parametrize("limit", [0, 1 << 16])
def test_components_by_both_steps(spark, monkeypatch, limit):
    """A round of few labels has one shuffle, of many the balanced ones; before, any round had about ten. Both give the same components."""
    components = pytest.importorskip("vcspark.llm.components")
    monkeypatch.setattr(components, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(skew, "BROADCAST_KEYS", limit)
    shuffles = []
    save = components.save_shared

    def seen(df, name):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return save(df, name)

    monkeypatch.setattr(components, "save_shared", seen)
    links = [(i, i + 1) for i in range(1, 20)] + [(500, i) for i in range(501, 900)] + [(30, 30), (None, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, **{i: 500 for i in range(500, 900)}}
    assert all(n == 1 for n in shuffles[2:]) == bool(limit)


def test_text_overlap_sends_blocks_and_no_pairs(spark, monkeypatch):
    """Every text was joined and counted with every query that shared a word with it; in small blocks and few hits at a time, with repeated and null ids and empty rows."""
    overlap = pytest.importorskip("vcspark.operators.overlap")
    for name, size in (("TEXTS", 7), ("QUERIES", 3), ("HITS", 5)):
        monkeypatch.setattr(overlap, name, size)
    rng = random.Random(8)
    some = lambda most: rng.sample("abcdefghijkl", rng.randint(0, most))
    texts = [(i if i % 11 else None, some(9)) for i in range(60)] + [(5, some(9)), (6, [])]
    queries = [(i, some(7)) for i in range(9)] + [(2, some(7)), (None, ["a"]), (90, [])]
    df = overlap.overlap_topk(spark.createDataFrame(texts, "doc_id long, pt array<string>"), spark.createDataFrame(queries, "item_id long, qt array<string>"), 3)
    got = {(r.item_id, r["rank"]): (r.doc_id, round(r.overlap * 10_000)) for r in df.collect()}
    want = {}
    for item in {i for i, _ in queries if i is not None}:
        asked = [w for i, q in queries if i == item for w in q]
        held = {d: sum(p.count(w) for e, p in texts if e == d for w in asked) for d, _ in texts}
        ranked = sorted(((d, (20_000 * c + len(asked)) // (2 * len(asked))) for d, c in held.items() if c), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
        want |= {(item, i + 1): x for i, x in enumerate(ranked[:3])}
    assert got == want and len(got) > 20
    plan = plans.QUERIES["text_overlap_topk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "doc_id" in line for line in plan.splitlines())
