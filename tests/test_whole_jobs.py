"""Queries over whole tables, held against brute force: no filter, prefix or sample may narrow them."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_queries import comparable
from vcspark import plans
from vcspark.functions import taxonomy
from vcspark.functions.taxonomy import identity_key
from vcspark.functions.text import text_overlap
from vcspark.functions.vectors import cosine_raw
from vcspark.operators import dedup, matching, nearest, ranking, reports, scoring, tracking
from vcspark.plans import video
from vcspark.plans.entities import view

SF = "/root/testdata/sf0.001"


def test_hamming_groups_hold_every_near_pair(spark):
    got = [tuple(r) for r in plans.QUERIES["hamming_pairs"](spark, SF).select("left_id", "right_id", "distance").collect()]
    hashes: dict[int, str] = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag").collect():
        h = hashlib.md5(r.day.encode()).hexdigest()[:13] + "00" + {"A": "1", "N": "3"}.get(r.l_returnflag, "7")
        i = r.l_orderkey * 8 + r.l_linenumber
        hashes[i] = min(h, hashes.get(i, h))
    rep: dict[str, int] = {}
    for i, h in hashes.items():
        rep[h] = min(i, rep.get(h, i))
    want = {(rep[h], i, 0) for i, h in hashes.items() if i != rep[h]}
    known = sorted((i, int(h, 16)) for h, i in rep.items())
    for n, (i, a) in enumerate(known):
        want |= {(i, j, d) for j, b in known[n + 1 :] if (d := (a ^ b).bit_count()) <= 6}
    assert len(got) == len(set(got)) and set(got) == want and any(i % 97 for _, i, _ in want)


WHOLE = ["vector_topk", "vector_topk_filtered", "text_overlap_topk", "cosine_neighbours"]


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """The smallest tables, with vectors also under ids from 500 on."""
    folder = tmp_path_factory.mktemp("larger")
    con = duckdb.connect()
    for t in ("part", "documents", "benchmark", "embeddings"):
        rows = pd.read_parquet(f"{SF}/{t}.parquet")
        if t == "embeddings":
            rows = pd.concat([rows, rows.assign(vec_id=rows.vec_id + len(rows))])
        rows.to_parquet(f"{folder}/{t}.parquet", index=False)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_equals_sql(spark, larger, name):
    folder, con = larger
    got = comparable(plans.QUERIES[name](spark, folder).toPandas())
    assert got and got == comparable(con.sql(plans.ORACLE_SQL[name]).df())


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    """In blocks of seven, on directions that lie in one step and in neighbouring ones."""
    monkeypatch.setattr(dedup, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    v = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.1, 0.2, 0.3)])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0]), (903, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.left_id, r.right_id) for r in dedup.near_vector_pairs(df, df, 0.96).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = set(zip(*(x.tolist() for x in np.nonzero(unit @ unit.T >= 0.96)))) | {(i, j) for i in (902, 903) for j in (902, 903)}
    assert got == want and len(want) > 100


def test_either_key_query_equals_a_plain_fold(spark):
    got = sorted((r.query_id, r.place, r.link) for r in plans.QUERIES["either_key_dedup"](spark, SF).collect())
    groups = {}
    for r in view(spark, SF, "candidates").collect():
        groups.setdefault(r.query_id, []).append((r.pos * 1_000_000 + r.product_id, r.link, (r.domain, r.title.lower())))
    want = []
    for q, rows in groups.items():
        links, titles = set(), set()
        for place, link, title in sorted(rows, key=lambda x: x[0]):
            if link not in links and title not in titles:
                links.add(link)
                titles.add(title)
                want.append((q, place, link))
    assert got == sorted(want) and len(got) < sum(map(len, groups.values()))


def test_either_key_repeats_go_by_order_whatever_the_partitions(spark):
    """Ties go by link, domain and title, not by arrival; groups go on from batch to batch, a task folds many."""
    rows = [(g, 1, link, "d", "T") for g in range(40) for link in ("b", "a")] + [(None, o, None if o % 2 else f"l{o}", "d", f"t{o}") for o in range(9)]
    rows += [(7, None, "z", "e", "last"), (7, 3, "z", "f", "first")]
    want = sorted([(str(g), 1, "a") for g in range(40)] + [("None", o, "None" if o % 2 else f"l{o}") for o in (0, 1, 2, 4, 6, 8)] + [("7", 3, "z")])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for given in (rows, rows[::-1]):
            df = spark.createDataFrame(given, "g long, o int, link string, domain string, title string").repartition(3)
            kept = ranking.drop_repeats(df, "g", "o")
            assert sorted((str(r.g), r.o, str(r.link)) for r in kept.collect()) == want
        assert "FlatMapGroups" not in kept._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_boxes_query_equals_brute_force(spark):
    """Within a frame and category, a box stays if no better one that stays covers it by 0.65."""
    got = sorted((r.job_id, r.detection_id) for r in plans.QUERIES["nms_boxes"](spark, SF).collect())
    frames = {}
    for r in video._boxes(spark, SF).collect():
        frames.setdefault((r.job_id, r.at), []).append(r)
    want = []
    for (job, _), rows in frames.items():
        held = []
        for r in sorted(rows, key=lambda r: (-r.confidence, r.detection_id)):
            if all(h.category != r.category or tracking.box_iou(*[(x.x, x.y, x.width, x.height) for x in (h, r)]) < 0.65 for h in held):
                held.append(r)
        want += [(job, r.detection_id) for r in held]
    assert got == sorted(want) and len(got) < sum(map(len, frames.values()))


def test_repeated_rows_keep_their_rate(spark):
    rates = spark.createDataFrame([("a", 1.0), ("ab", 2.0)], "prefix string, rate double")
    rows = spark.createDataFrame([("abc",), ("abc",), ("ax",), ("b",), ("",), (None,)], "name string")
    assert sorted(map(tuple, reports.longest_prefix_rate(rows, "name", rates).collect())) == [("abc", 2.0), ("abc", 2.0), ("ax", 1.0)]


def test_blocks_of_queries_change_nothing(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], None) for i in range(60)], "query_id long, vector array<double>, category string")
    products = rows.withColumnRenamed("query_id", "product_id")
    whole = sorted(map(tuple, matching.match_vectors(rows, products, 5, 0.2).collect()))
    assert whole == sorted(map(tuple, matching.match_vectors_in_blocks(rows, products, 5, 0.2, block=9).collect())) and len(whole) == 300


def _vectors(seed: int, n: int, names: list[str | None]) -> list[tuple]:
    """Vectors with copies, zeros, nulls, other lengths, near ties and numbers that no length can be taken of."""
    rng = np.random.default_rng(seed)
    base = np.round(rng.normal(size=(n // 3, 4)), 2)
    rows = [x.tolist() for x in base] + [x.tolist() for x in base] + [(x + rng.normal(size=4) * 1e-5).tolist() for x in base]
    rows += [[0.0] * 4, None, [], [1.0, None, 2.0, 3.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], [1e200, 1.0, 1.0, 1.0], [1e-200, 0.0, 0.0, 0.0]]
    return [(i * 7 % 1009, v, names[i % len(names)]) for i, v in enumerate(rows)]


def _by_pairs(queries, products, k, least):
    """The same scores by an expression over every pair."""
    q, p = queries.toDF("query_id", "qv", "qc"), products.toDF("product_id", "pv", "pc")
    pairs = p.join(q, (F.size("pv") == F.size("qv")) & (F.col("pc").isNull() | F.col("qc").isNull() | (F.col("pc") == F.col("qc"))))
    visual = F.greatest(F.lit(0.0), cosine_raw("pv", "qv"))
    scored = pairs.select("query_id", "product_id", F.round(visual, 4).alias("visual_score"), F.round(0.85 * visual + 0.15, 4).alias("final_score"))
    return sorted(str(tuple(r)) for r in matching.rank_matches(scored, "query_id", "product_id", k, least).collect())


@pytest.mark.parametrize("names", [[None], ["a", "b", None, "c"]])
@pytest.mark.parametrize("least", [0.1, 0.6])
def test_block_search_equals_every_pair(spark, monkeypatch, names, least):
    for name, size in (("PRODUCT_BLOCK", 40), ("QUERY_BLOCK", 25), ("CHUNK", 16), ("QUERY_CHUNK", 7), ("CATEGORY_GROUPS", 2)):
        monkeypatch.setattr(nearest, name, size)
    products = spark.createDataFrame(_vectors(1, 150, names), "product_id long, vector array<double>, category string")
    queries = spark.createDataFrame(_vectors(1, 60, names), "query_id long, vector array<double>, category string")
    found = matching.match_vectors(queries, products, 4, least)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = sorted(str(tuple(r)) for r in found.collect())
    assert got == _by_pairs(queries, products, 4, least) and len(got) > 200


_ROW = "id long, source string, source_product_id string, canonical_url string, image_sha256 string, sku string, gtin string, brand string, title string, color string, perceptual_hash string, embedding array<double>"


def test_ladder_equals_every_pair(spark):
    """Every level and its guard, with nulls, against a look at each pair."""
    r = random.Random(3)
    pick = lambda values, share: r.choice(values) if r.random() < share else None
    hashes = [f"{r.getrandbits(64):016x}" for _ in range(6)]
    close = lambda h: h and f"{int(h, 16) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)):016x}"
    axes = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    near = lambda v: v and [x + r.gauss(0, 0.03) for x in v] if r.random() < 0.7 else v

    def made(ids):
        return [(i, pick("abc", 0.9), pick("1234567", 0.6), pick([f"u{n}" for n in range(300)], 0.3), pick([f"i{n}" for n in range(300)], 0.3), pick([f"k{n}" for n in range(200)], 0.3), pick([f"g{n}" for n in range(300)], 0.3),
                 pick(["x", "y"], 0.9), pick(["t", "u", "w"], 0.9), pick(["red", "blue"], 0.9), close(pick(hashes, 0.3)), near(pick(axes, 0.4))) for i in ids]

    products, wanted = made(range(100, 180)), made(range(1, 150))
    p, c = (spark.createDataFrame(x, _ROW) for x in (products, wanted))
    keys = {(n, r.id): r.k for n, t in (("c", c), ("p", p)) for r in t.select("id", identity_key("brand", "title", "color").alias("k")).collect()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want = {}
    for a in wanted:
        for b in products:
            same = lambda n: a[n] is not None and a[n] == b[n]  # noqa: E731,B023
            apart = same(1) and a[2] is not None and b[2] is not None and a[2] != b[2] and not same(5) and not same(6)
            n = 0 if same(1) and same(2) else 1 if same(3) else 2 if same(4) else 3 if same(5) or same(6) else None
            if n is None and not apart:
                n = 4 if a[10] and b[10] and (int(a[10], 16) ^ int(b[10], 16)).bit_count() <= 6 else 5 if a[11] and b[11] and cosine(a[11], b[11]) >= 0.96 else 6 if keys["c", a[0]] is not None and keys["c", a[0]] == keys["p", b[0]] else None
            if n is not None:
                want[a[0]] = min(want.get(a[0], (9, 0)), (n, b[0]))
    got = {x.candidate_id: (dedup.LEVELS.index(x.level), x.product_id) for x in dedup.find_duplicates(c, p).collect()}
    assert got == want and {n for n, _ in got.values()} == set(range(7))


def test_ladder_makes_no_pairs_of_a_common_key(spark):
    """Twenty thousand candidates and as many products under one name, hash and vector."""
    rows = spark.range(40_000).selectExpr("id", "cast(id % 2 AS string) AS source", "cast(id AS string) AS source_product_id", *[f"cast(null AS string) AS {c}" for c in ("canonical_url", "image_sha256", "sku", "gtin")], "'x' AS brand", "'t' AS title", "'red' AS color", "'00ff00ff00ff00ff' AS perceptual_hash", "array(1.0D, 2.0D) AS embedding")
    c, p = rows.where("id % 4 < 2"), rows.where("id % 4 >= 2")
    found = dedup.find_duplicates(c, p)
    assert {tuple(r) for r in found.groupBy(F.col("candidate_id") % 4, "product_id", "level").count().collect()} == {(0, 3, "perceptual_hash", 10_000), (1, 2, "perceptual_hash", 10_000)}


def test_full_match_normalises_no_text_for_a_pair(spark):
    plan = plans.QUERIES["full_product_match"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan and "regexp_replace" not in plan


def test_boxes_of_many_frames_go_in_one_pass(spark):
    """Frames go on from batch to batch, null and odd confidences come last; no call for each frame."""
    box = lambda g, i, c, x=0.1: (g, i, c, "K", x, 0.1, 0.3, 0.3)
    rows = [box(g, i, c) for g in (None, *range(30)) for i, c in ((1, 0.2), (2, 0.9), (3, None), (4, float("nan")), (5, 0.9))] + [box(3, 9, 0.1, 0.6), box(3, 8, 0.1, -1.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame(rows, "g long, detection_id long, confidence double, category string, x double, y double, width double, height double").repartition(3)
        kept = tracking.suppress_boxes(df, ["g"])
        assert sorted((str(r.g), r.detection_id) for r in kept.collect()) == sorted([(str(g), 2) for g in (None, *range(30))] + [("3", 8), ("3", 9)])
        assert "FlatMapGroups" not in kept._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _match_rows(r: random.Random, numbers: range) -> tuple[list[tuple], list[tuple]]:
    """Products and queries with every field missing, blank and odd at times, shared files, near hashes and vectors of several kinds."""
    pick = lambda values, share=0.8: r.choice(values) if r.random() < share else None
    hashes, axes = [f"{r.getrandbits(64):016x}" for _ in range(5)], [[r.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    close = lambda h: h and f"{int(h, 16) ^ r.choice([0, 1, 5, 255, 2**40 - 1]):016x}"
    odd = [[0.0] * 6, [], [1.0, None, 2.0, 3.0, 0.0, 0.0], [1.0, 2.0], [float("nan")] + [1.0] * 5, [1e200] + [1.0] * 5, [1e-200] + [0.0] * 5]
    vector = lambda share: r.choice(odd) if r.random() < 0.12 else [x + r.choice([0.0, r.gauss(0, 0.2)]) for x in r.choice(axes)] if r.random() < share else None
    name = lambda: " ".join(r.sample(["Red", "lámpara", "ring", "oak", "blue-bolt", "x"], r.randrange(4)))
    files, kinds, brands, colours = [f"f{n}" for n in range(12)] + [""], ["watch", "Relojes", "joyeria", "bag", "all", "bolso", "!!", "mine"], ["H&M", "h and m", "Zara", "!", "zara home"], ["rojo", "azul marino", "navy", "?", "teal"]
    genders, stuff = ["women", "men", "unisex", "", "Niño"], ["Lana", "lana ", "cotton", ""]
    common = lambda: (pick(brands, 0.5), pick(colours, 0.6), pick(genders), pick(stuff, 0.5), pick(stuff, 0.4))
    products, queries = [], []
    for n in numbers:
        images = [(pick(["u", ""]), pick(files), pick([0, 250, 500, 900]), pick([300, 700])) for _ in range(r.randrange(3))]
        digest = r.choice(["", "0", "ab", close(r.choice(hashes)), close(r.choice(hashes)), None])
        products.append((n, r.random() < 0.95, pick([images]), pick(["p", ""], 0.3), digest, vector(0.7), vector(0.3), name(), pick(kinds), pick(["sub", "oak"], 0.2), pick(["fine ring"], 0.2), pick([[], ["rojo", None], ["NAVY", "?"]], 0.5), *common()))
        digest = r.choice(["", "0", close(r.choice(hashes)), close(r.choice(hashes)), None])
        words = r.choice([None, " ", "!!", name(), name(), name()])
        queries.append((n, pick(files, 0.3), digest, vector(0.8), words, vector(0.3), pick(kinds, 0.4), r.choice([None, "ring", "a oak", "!", ""]), pick([True, False], 0.4), *common()[1:], pick(brands, 0.2)))
    return products, queries


_COMMON = "color string, gender string, material string, pattern string"
_PRODUCT = "product_id long, is_active boolean, images array<struct<url string, sha256 string, width int, height int>>, primary_image string, perceptual_hash string, embedding array<double>, text_embedding array<double>, title string, category string, subcategory string, style string, secondary_colors array<string>, brand string, " + _COMMON
_QUERY = "query_id long, image_sha256 string, perceptual_hash string, embedding array<double>, query_text string, text_embedding array<double>, category string, type string, require_image boolean, " + _COMMON + ", brand string"


def _match_by_pairs(queries, products, k, least):
    """The match by an expression over every pair."""
    p, q = (t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns]) for t, s in ((products.where("is_active"), "p"), (queries, "q")))
    of = lambda s, t: {c: F.col(f"{s}_{c}") for c in t.columns}
    x, y = of("p", products), of("q", queries)
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    image, text = said(y["image_sha256"]) | said(y["perceptual_hash"]) | y["embedding"].isNotNull(), F.coalesce(F.trim(y["query_text"]), F.lit("")) != ""
    shown = said(x["primary_image"]) | F.coalesce(F.exists(x["images"], lambda i: F.coalesce(i["url"], F.lit("")) != ""), F.lit(False))
    brand = taxonomy.canonical_brand(y["brand"])
    fits = taxonomy.categories_match(x["category"], y["category"]) & F.coalesce(brand.isNull() | (brand == taxonomy.canonical_brand(x["brand"])), F.lit(False)) & ~taxonomy.gender_conflict(x["gender"], y["gender"]) & (~F.coalesce(y["require_image"], image) | shown)
    cosine = lambda n: F.when(x[n].isNotNull() & y[n].isNotNull() & (F.size(x[n]) == F.size(y[n])), cosine_raw(x[n], y[n]))
    visual = matching.visual_score(y["image_sha256"], F.transform(x["images"], lambda i: i["sha256"]), y["perceptual_hash"], x["perceptual_hash"], cosine("embedding"))
    overlap = text_overlap(y["query_text"], x["brand"], x["title"], x["category"], x["color"])
    pairs = p.crossJoin(q).where(fits).select(
        y["query_id"], x["product_id"], F.when(image, visual).alias("v"), image.alias("image"), text.alias("text"), matching.image_quality(x["images"]).alias("quality"), matching.attribute_score(matching.attribute_checks(x, y)).alias("a"),
        F.when(text, F.greatest(overlap, F.coalesce(F.greatest(F.lit(0.0), cosine("text_embedding")), F.lit(0.0)))).otherwise(0.0).alias("t"),
    ).where("not image or v is not null").withColumn("s", F.coalesce("v.score", F.lit(0.0)))
    final = matching.combine_scores(F.col("s"), F.col("t"), F.col("a"), F.col("image"), F.col("text"))
    scored = pairs.select(F.col("q_query_id").alias("query_id"), F.col("p_product_id").alias("product_id"), *[F.round(c, 4).alias(n) for c, n in (("s", "visual_score"), ("t", "text_score"), ("a", "attribute_score"))], F.col("v.stage").alias("stage"), F.round(final, 4).alias("final_score"), F.round("quality", 4).alias("image_quality"))
    return sorted(str(tuple(r)) for r in matching.rank_matches(scored, "query_id", "product_id", k, least).collect())


@pytest.mark.parametrize(("seed", "k", "least"), [(1, 4, 0.3), (2, 60, 0.1)])
def test_full_match_in_blocks_equals_every_pair(spark, monkeypatch, seed, k, least):
    for name, size in (("PRODUCT_BLOCK", 40), ("LEAST_BLOCK", 20), ("QUERY_BLOCK", 25), ("PAIRS", 90)):
        monkeypatch.setattr(scoring, name, size)
    made, asked = _match_rows(random.Random(seed), range(150))
    products, queries = spark.createDataFrame(made, _PRODUCT), spark.createDataFrame(asked[:70], _QUERY)
    found = matching.match_products(queries, products, k, least)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = sorted(str(tuple(r)) for r in found.collect())
    assert got == _match_by_pairs(queries, products, k, least) and len(got) > 150 and all(any(s in r for r in got) for s in (*scoring.STAGES, "None"))


def test_scores_round_as_spark_rounds(spark):
    values = [0.6 * (1 - d / 64) + 0.25 * t / 4 + 0.15 * a / 6 for d in range(7) for t in range(5) for a in range(7)] + [n / 20_000 for n in range(200)] + [0.00005, 1.00005, 0.30000000000000004, float("nan")]
    want = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 4).alias("r")).collect()]
    assert np.array_equal(scoring.round_half_up(np.array(values), 4), np.array(want), equal_nan=True)
