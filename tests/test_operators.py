"""Relational operators on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vcspark.operators import dedup, extraction, matching, ranking, skew, timeline, tracking, upserts
from vcspark.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, None if i % 7 == 0 else ("hot" if i % 3 else f"k{i}")) for i in range(3000)], "id long, k string")
    keyed = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    joined = skew.salted_join(left, keyed, ["k"], "n", "id")
    assert joined.count() == 3000
    want = {k: (n, f) for k, n, f in keyed.collect()}
    assert all((r["n"], r["first"]) == want[r["k"]] for r in joined.collect())


def test_cascade_and_quality(spark):
    image = F.array(F.struct(F.lit(500).alias("width"), F.lit(900).alias("height")))
    none = F.array().cast("array<struct<width:int,height:int>>")
    q, near = F.lit("aa00aa00aa00aa00"), F.lit("aa00aa00aa00aa03")
    got = spark.range(1).select(
        matching.visual_score(F.lit("s"), F.array(F.lit("s")), q, near, F.lit(0.1)).alias("a"), matching.visual_score(F.lit("x"), F.array(F.lit("s")), q, near, F.lit(0.1)).alias("b"),
        matching.visual_score(F.lit("x"), F.array(F.lit("s")), q, F.lit("00ff00ff00ff00ff"), F.lit(-0.1)).alias("c"), matching.image_quality(image).alias("q"), matching.image_quality(none).alias("u"),
    ).first()
    assert tuple(got.a) == (1.0, "exact_hash") and tuple(got.b) == (1 - 2 / 64, "perceptual_hash") and tuple(got.c) == (0.0, "embedding")
    assert got.q == 0.5 and got.u == 0.5


def test_attributes(spark):
    null = F.lit(None).cast("string")
    p = {"category": F.lit("dress"), "brand": F.lit("Zara"), "color": F.lit("rojo"), "secondary_colors": F.array(F.lit("azul")), "subcategory": null, "style": null, "title": F.lit("Vestido midi"), "material": null, "pattern": null}
    q = {"category": F.lit("vestidos"), "brand": F.lit("ZARA"), "color": F.lit("blue"), "type": F.lit("midi"), "material": F.lit("lino"), "pattern": null}
    nothing = dict.fromkeys(q, null)
    score = lambda q: spark.range(1).select(matching.attribute_score(matching.attribute_checks(p, q))).first()[0]
    assert score(q) == 1.0
    assert score(nothing) == 0.5
    assert score(nothing | {"category": F.lit("footwear")}) == 0.0


@pytest.mark.parametrize(("score", "signals", "want"), [(138, ["exact_image_match"], "exact"), (88, ["exact_image_match"], "near_exact"), (145, ["same_brand", "visible_text_match"], "near_exact"), (70, ["lens_top_position"], "similar"), (25, [], None)])
def test_classify(spark, score, signals, want):
    b = {k: F.lit(1 if k in signals else 0) for k in ranking.POINTS}
    assert spark.range(1).select(ranking.classify_match(F.lit(score), b)).first()[0] == want


def test_either_key_repeats_leave_no_keys(spark):
    df = spark.createDataFrame([("g", 1, "a", "d", "T"), ("g", 2, "a", "e", "U"), ("g", 3, "b", "e", "u"), ("g", 4, "c", "d", "t")], "g string, o int, link string, domain string, title string")
    assert [r.o for r in ranking.drop_repeats(df, "g", "o").orderBy("o").collect()] == [1, 3]


def test_near_hashes_equal_brute_force(spark):
    import random

    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    values = [b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(9))) & (2**64 - 1) for b in base for _ in range(4)]
    df = spark.createDataFrame([(i, f"{v % 2**64:016x}") for i, v in enumerate(values)], "id long, hash string")
    got = {(a, b): d for a, b, d in dedup.near_hash_pairs(df, df).where("left_id < right_id").collect()}
    want = {(i, j): (values[i] % 2**64 ^ values[j] % 2**64).bit_count() for i in range(len(values)) for j in range(i + 1, len(values))}
    assert got == {k: d for k, d in want.items() if d <= 6}


def test_ladder_guard(spark):
    schema = "id long, source string, source_product_id string, canonical_url string, image_sha256 string, sku string, gtin string, brand string, title string, color string, perceptual_hash string"
    catalogue = spark.createDataFrame([(1, "a", "1", "u1", None, None, None, "Zara", "Vestido", "rojo", "aa00aa00aa00aa00")], schema)
    candidates = spark.createDataFrame([(10, "a", "2", "u2", None, None, None, "Zara", "Vestido", "red", "aa00aa00aa00aa01"), (11, "b", "9", "u9", None, None, None, "zara", "VESTIDO", "red", "ffff00000000ffff"), (12, "b", "8", "u8", None, None, None, "x", "y", None, "aa00aa00aa00aa01"), (13, "b", "7", "u1", None, None, None, None, "z", None, None)], schema)
    assert rows(dedup.find_duplicates(candidates, catalogue)) == [(11, 1, "brand_title_color"), (12, 1, "perceptual_hash"), (13, 1, "canonical_url")]
    assert rows(dedup.find_duplicates(candidates, catalogue, exact_only=True)) == [(13, 1, "canonical_url")]


def test_upserts(spark):
    schema = "fingerprint string, seq int, confidence double, seen_count int, color string, tags array<string>, status string"
    base = spark.createDataFrame([("a", 1, 0.9, 3, "red", ["x"], "ok")], schema)
    delta = spark.createDataFrame([("a", 2, 0.5, 1, None, [], "new"), ("b", 3, 0.1, 1, None, ["y"], "new")], schema)
    got = {r.fingerprint: r for r in upserts.fingerprint_upsert(base, delta, latest=("color",), lists=("tags",), keep=("status",)).collect()}
    assert (got["a"].confidence, got["a"].seen_count, got["a"].color, got["a"].tags, got["a"].status, got["a"].created) == (0.9, 4, "red", ["x"], "ok", False)
    assert got["b"].created is True and got["b"].color is None
    keyed = spark.createDataFrame([(None, 1), ("k", 2)], "k string, n long")
    assert rows(upserts.additive_upsert(keyed, keyed, ["k"], ["n"])) == [("k", 4), (None, 2)]


def test_segments(spark):
    df = spark.createDataFrame([("v", t) for t in (0.0, 0.4, 0.8, 5.0, 5.2)], "v string, t double")
    assert [(r.start, r.end) for r in timeline.segments(df, ["v"], "t").orderBy("start").collect()] == [(0.0, 0.8), (5.0, 5.2)]


@pytest.mark.parametrize(("scenes", "duration", "percent", "gaps"), [([(0.0, 3.0, 1), (7.0, 10.0, 1)], 10000, 60.0, [(3000, 7000)]), ([(2.0, 6.0, 1)], 10000, 40.0, [(0, 2000), (6000, 10000)]), ([], 10000, 0.0, [(0, 10000)]), ([], 0, 100.0, [])])
def test_coverage(spark, scenes, duration, percent, gaps):
    s = spark.createDataFrame([("j", *x) for x in scenes], "job_id string, start_seconds double, end_seconds double, analyzed_frame_count int")
    d = spark.createDataFrame([("j", duration)], "job_id string, duration_ms long")
    assert timeline.coverage(s, d).first().coverage_percent == percent
    assert sorted((r.start_ms, r.end_ms) for r in timeline.uncovered_ranges(s, d).collect()) == gaps


def test_nearest_within(spark):
    left = spark.createDataFrame([("v", 1, 10.0), ("v", 2, 50.0), ("w", 3, 1.0)], "k string, id long, t double")
    right = spark.createDataFrame([("v", 7, 9.9), ("v", 8, 10.1), ("v", 6, 30.0)], "k string, rid long, rt double")
    assert [(r.id, r.nearest_id) for r in timeline.nearest(left, right, "k", "t", "rt", "rid", within=0.25).orderBy("id").collect()] == [(1, 7), (2, None), (3, None)]


def detections(spark, data):
    return spark.createDataFrame(data, "job_id string, at double, detection_id long, name string, category string, x double, y double, width double, height double, confidence double")


def test_tracker(spark):
    df = detections(spark, [("j", 0.0, 1, "taza azul", "home", 0.1, 0.1, 0.2, 0.2, 0.9), ("j", 0.0, 2, "otra cosa", "home", 0.7, 0.7, 0.2, 0.2, 0.9), ("j", 1.0, 3, "jarra", "home", 0.12, 0.1, 0.2, 0.2, 0.9), ("j", 2.0, 4, "otra cosa", "home", 0.1, 0.5, 0.2, 0.2, 0.9), ("j", 20.0, 5, "otra cosa", "home", 0.1, 0.5, 0.2, 0.2, 0.9)])
    assert [r.track_id for r in tracking.assign_tracks(df).orderBy("detection_id").collect()] == ["t1", "t2", "t1", "t2", "t3"]


def test_suppression(spark):
    df = detections(spark, [("j", 0.0, 1, "a", "c", 0.1, 0.1, 0.4, 0.4, 0.6), ("j", 0.0, 2, "a", "C ", 0.11, 0.1, 0.4, 0.4, 0.95), ("j", 0.0, 3, "a", "d", 0.1, 0.1, 0.4, 0.4, 0.5), ("j", 0.0, 4, "a", "c", None, None, None, None, 0.1)])
    assert sorted(r.detection_id for r in tracking.suppress_boxes(df, ["job_id", "at"]).collect()) == [2, 3, 4]


def test_identity(spark):
    schema = "job_id string, track_id string, first_seen double, last_seen double, slot string, category string, family string, person_index int, color string, visual array<double>, duration double"
    same, other = [1.0, 0.0], [-1.0, 0.0]
    tracks = spark.createDataFrame([("j", f"t{i}", float(i), i + 1.0, "upper", "t-shirt", "clothing", None, "blanco", same, 60.0) for i in range(5)] + [("j", "t9", 9.0, 10.0, "lower", "trousers", "clothing", None, "blanco", same, 60.0), ("j", "u", 11.0, 12.0, "upper", "t-shirt", "clothing", None, "negro", other, 60.0)], schema)
    got = {r.track_id: r.product_index for r in tracking.identity_groups(tracks).collect()}
    assert {got[f"t{i}"] for i in range(5)} == {0} and got["t9"] == 1 and got["u"] == 2


def test_canonical_label(spark):
    df = spark.createDataFrame([("j", x) for x in ["camiseta", "Camiseta", "camiseta blanca de manga corta", "camiseta blanca de manga corta", "a/b", "a/b", "a/b"]], "job string, label string")
    assert tracking.canonical_labels(df, ["job"], "label").first().label == "camiseta blanca de manga corta"


def test_layers(spark):
    page = """<html><head><meta property="og:title" content="OG &amp; co"><script type="application/ld+json">{"@type":"Product","name":"LD","offers":{"price":"9.95","priceCurrency":"EUR"}} trailing</script></head><h1>Dom</h1></html>"""
    pages = spark.createDataFrame([(1, "u", page), (2, "v", None)], "page_id long, url string, html string")
    best = extraction.strongest_layers(extraction.page_layers(pages), ["page_id"], "field", "value", "priority")
    assert {(r.field, r.layer, r.value) for r in best.collect()} == {("title", "json_ld", "LD"), ("price", "json_ld", "9.95"), ("currency", "json_ld", "EUR")}
    need = lambda *f: spark.range(1).select(extraction.needs_escalation(F.array(*map(F.lit, f)))).first()[0]
    assert need("title") and need("title", "price", "currency", "image", "brand", "color") and not need("title", "price", "currency", "image", "brand", "color", "category")


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a ""b"" c"\n2,na\n,x\n')
    assert [tuple(r) for r in readers.read_dataset_csv(spark, str(tmp_path / "a.csv"), "id long, name string").collect()] == [(1, 'a "b" c'), (2, None)]
    xml = "<urlset><url><loc> https://a.es/?x=1&amp;y=2 </loc></url><url><loc><![CDATA[https://b.es]]></loc></url></urlset>"
    assert spark.range(1).select(readers.sitemap_locations(F.lit(xml))).first()[0] == ["https://a.es/?x=1&y=2", "https://b.es"]
    robots = spark.createDataFrame([("h", "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /a\nAllow: /a/b # c\n")], "host string, text string")
    paths = spark.createDataFrame([("h", "/a/x"), ("h", "/a/b/c"), ("h", "/z"), ("g", "/a")], "host string, path string")
    assert rows(readers.allowed_paths(paths, readers.robots_rules(robots))) == [("g", "/a", True), ("h", "/a/b/c", True), ("h", "/a/x", False), ("h", "/z", True)]
    first = readers.write_version(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(first).count() == 3
