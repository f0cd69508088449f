"""A batch ingested at once against taking its rows one after the other."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import pytest

from vcspark import plans
from vcspark.operators import ingest as op
from vcspark.plans import ingestion

SF = "/root/testdata/sf0.001"
KEYS = [("source_product_id", ("source", "source_product_id")), ("canonical_url", ("canonical_url",)), ("image_sha256", ("image_sha256",)), ("sku_gtin", ("sku",)), ("sku_gtin", ("gtin",))]


def fold(batch, catalogue):
    """Outcomes by seq and the products at the end; a product is found by the keys it was made with."""
    products = [dict(p, keys=p, ref=(0, p["id"])) for p in sorted(catalogue, key=lambda p: p["id"])]
    index = {}

    def add(p):
        for kind, (_, names) in enumerate(KEYS):
            value = tuple(p["keys"][n] for n in names)
            if all(value):
                index.setdefault((kind, value), []).append(p)

    for p in products:
        add(p)
    out = {}
    for row in sorted(batch, key=lambda r: r["seq"]):
        match = None
        for kind, (level, names) in enumerate(KEYS):
            value = tuple(row[n] for n in names)
            hits = index.get((kind, value), []) if all(value) else []
            if kind == 4 and match and match[0] == "sku_gtin":
                hits = hits + [match[1]]
                match = None
            if hits and not match:
                match = (level, min(hits, key=lambda p: p["ref"]))
        if match is None:
            p = dict(row, keys=row, ref=(1, row["seq"]), origin="scraped", first_seen=row["seen"], last_seen=row["seen"], history=[(row["seen"], row["price"])] if row["price"] is not None else [])
            products.append(p)
            add(p)
            out[row["seq"]] = ("new", None, None, row["seq"], row["price"] is not None)
            continue
        level, p = match
        p["last_seen"] = max(p["last_seen"], row["seen"]) if p["ref"][0] or p.get("touched") else row["seen"]
        p["first_seen"] = min(p["first_seen"], row["seen"]) if p["ref"][0] else p["first_seen"]
        p["touched"] = True
        ids = (p["ref"][1], None) if p["ref"][0] == 0 else (None, p["ref"][1])
        if level not in ("source_product_id", "canonical_url"):
            out[row["seq"]] = ("duplicate", level, *ids, False)
        elif p["content_hash"] == row["content_hash"]:
            out[row["seq"]] = ("unchanged", level, *ids, False)
        else:
            point = row["price"] is not None and row["price"] != p["price"]
            p["content_hash"], p["price"] = row["content_hash"], row["price"]
            if point:
                p["history"] = p["history"] + [(row["seen"], row["price"])]
            out[row["seq"]] = ("changed", level, *ids, point)
    return out, products


def outcomes(df):
    return {r.seq: (r.action, r.level, r.product_id, r.made_by, r.price_point) for r in df.collect()}


BATCH = "seq long, source string, source_product_id string, canonical_url string, image_sha256 string, sku string, gtin string, content_hash string, price double, seen timestamp"
CATALOGUE = "id long, source string, source_product_id string, canonical_url string, image_sha256 string, sku string, gtin string, content_hash string, price double, origin string, first_seen timestamp, last_seen timestamp, history array<struct<seen timestamp, price double>>"


def made(rng, n, first):
    rows = []
    for i in range(first, first + n):
        c = rng.choice("abc")
        keys = [rng.choice(["s", "t"]), rng.choice([None, "", *map(str, range(8))]), rng.choice([None, *map(str, range(9))]), rng.choice([None, None, *map(str, range(12))]), rng.choice(["", None, *map(str, range(15))]), rng.choice([None, *map(str, range(15))])]
        rows.append((i, *keys, c, {"a": 1.0, "b": 2.0, "c": None}[c]))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ingest_equals_one_row_after_the_other(spark, monkeypatch, seed):
    monkeypatch.setattr(op, "_CHUNK", 7)
    rng, day = random.Random(seed), datetime(2024, 1, 1)
    batch = [(*r, datetime(2024, 2, 1 + r[0] % 27)) for r in made(rng, 60, 100)]
    catalogue = [(*r, "dataset_demo", day, day, [(day, 9.0)]) for r in made(rng, 6, 1)]
    b, c = spark.createDataFrame(batch, BATCH), spark.createDataFrame(catalogue, CATALOGUE)
    done = op.ingest(b.withColumn("action", b["sku"]), c)
    want, products = fold([r.asDict() for r in b.collect()], [dict(r.asDict(), history=[tuple(h) for h in r.history]) for r in c.collect()])
    assert outcomes(done) == want
    counters = op.import_counters(done).first()
    n = Counter(w[0] for w in want.values())
    assert (counters.received, counters.created, counters.duplicates, counters.updated, counters.unchanged) == (60, n["new"], n["duplicate"], n["changed"], n["unchanged"])
    after = {(r.id, r.made_by): (r.origin, r.content_hash, r.price, r.first_seen, r.last_seen, [tuple(h) for h in r.history]) for r in op.ingested_catalogue(c, b, done).collect()}
    assert after == {((p["ref"][1], None) if p["ref"][0] == 0 else (None, p["ref"][1])): (p["origin"], p["content_hash"], p["price"], p["first_seen"], p["last_seen"], p["history"]) for p in products}


def test_ingest_of_empty_tables_and_rows_without_keys(spark):
    none = spark.createDataFrame([], CATALOGUE)
    rows = [(i, None, "", None, None, "", None, None, None, None) for i in (1, 2)] + [(3, None, None, "u", None, None, None, "h", 1.0, None), (4, None, None, "u", None, None, None, "h", 1.0, None)]
    batch = spark.createDataFrame(rows, BATCH)
    assert outcomes(op.ingest(batch, none)) == {1: ("new", None, None, 1, False), 2: ("new", None, None, 2, False), 3: ("new", None, None, 3, True), 4: ("unchanged", "canonical_url", None, 3, False)}
    assert op.ingest(batch.limit(0), none).count() == 0


def test_ingest_queries_equal_the_fold(spark):
    batch = [r.asDict() for r in ingestion.listings(spark, SF).collect()]
    want, products = fold(batch, [dict(r.asDict(), history=[tuple(h) for h in r.history]) for r in ingestion.products(spark, SF).collect()])
    assert outcomes(plans.QUERIES["ingest_batch"](spark, SF)) == want
    assert len(Counter(w[0] for w in want.values())) == 4 and {w[3] is None for w in want.values() if w[0] == "changed"} == {True, False}
    got = {(r.id, r.made_by): (r.price, r.points) for r in plans.QUERIES["ingest_catalogue"](spark, SF).collect()}
    assert got == {((p["ref"][1], None) if p["ref"][0] == 0 else (None, p["ref"][1])): (p["price"], len(p["history"])) for p in products}
