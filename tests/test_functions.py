"""Scalar functions against stated values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vcspark.functions import geometry, taxonomy, text, vectors
from vcspark.functions.hashing import bands, djb2, hamming, hash_embedding


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(("x", "want"), [("  Vestido MIDI — Édition Limitée!  ", "vestido midi edition limitee"), (None, ""), ("Ñandú", "nandu")])
def test_norm_strict(spark, x, want):
    assert one(spark, text.norm_strict(F.lit(x).cast("string"))) == want


def test_norm_basic_keeps_punctuation(spark):
    assert one(spark, text.norm_basic(F.lit("  Édition,  Limitée! "))) == "edition, limitee!"


@pytest.mark.parametrize(("x", "want"), [("azul marino", "navy"), ("NAVY", "navy"), ("Azul marino intenso", "navy"), ("Rojo", "red"), ("raro", "raro"), ("", None), (None, None)])
def test_colour(spark, x, want):
    assert one(spark, taxonomy.canonical_colour(F.lit(x).cast("string"))) == want


@pytest.mark.parametrize(("x", "want"), [("Vestidos", "dress"), ("Zapatillas deportivas", "sneakers"), ("T-Shirt", "t-shirt"), ("prenda superior", "clothing"), ("accesorio", "bags_accessories"), ("bags_accessories", "bags_accessories"), ("Perfume and Body Mist", "fragrance"), ("Watches", "watch"), ("Blazers", "blazer"), (None, None)])
def test_category(spark, x, want):
    assert one(spark, taxonomy.canonical_category(F.lit(x).cast("string"))) == want


@pytest.mark.parametrize(("a", "b", "want"), [("clothing", "vestidos", True), ("footwear", "vestidos", False), (None, "x", True), ("t-shirt", "prenda superior", True), ("all", "bag", True)])
def test_categories_match(spark, a, b, want):
    assert one(spark, taxonomy.categories_match(F.lit(a).cast("string"), F.lit(b))) is want


def test_compatible_categories():
    assert taxonomy.compatible_categories("dress") == ["dress", "clothing"]
    assert "boots" in taxonomy.compatible_categories("footwear")
    assert taxonomy.compatible_categories("all") is None
    assert taxonomy.compatible_categories("unheard of") is None


@pytest.mark.parametrize(("a", "b", "want"), [("women", "men", True), (None, "men", False), ("unisex", "men", False), ("niño", "men", False), ("men", "MEN", False)])
def test_gender_conflict(spark, a, b, want):
    assert one(spark, taxonomy.gender_conflict(F.lit(a).cast("string"), F.lit(b))) is want


@pytest.mark.parametrize(("x", "want"), [("39,95 €", 39.95), ("$1,299.00", 1299.0), ("1.299,50", 1299.5), ("sin precio", None), (None, None), ("-5", -5.0), ("1-2", None)])
def test_price(spark, x, want):
    assert one(spark, text.parse_price(F.lit(x).cast("string"))) == want


@pytest.mark.parametrize(("x", "want"), [("https://schema.org/InStock", "in_stock"), ("https://schema.org/OutOfStock", "out_of_stock"), (None, "unknown"), ("unavailable", "in_stock")])
def test_availability(spark, x, want):
    assert one(spark, text.availability(F.lit(x).cast("string"))) == want


@pytest.mark.parametrize(("x", "width", "want"), [(4.0, 5, 0), (5.0, 5, 5), (14.9, 5, 10), (-3.0, 5, 0), (17.0, 10, 10)])
def test_time_bucket(spark, x, width, want):
    assert one(spark, text.time_bucket(F.lit(x), width)) == want


def test_urls(spark):
    url = F.lit("https://www.Shop.es/a/b/?q=1#x")
    assert one(spark, text.canonical_url(url), text.url_domain(url), text.host_path_key(url)) == ("https://www.Shop.es/a/b/", "shop.es", "shop.es/a/b")


def test_overlap_and_words(spark):
    assert one(spark, text.text_overlap(F.lit("vestido rojo"), F.lit("Vestido midi rojo"))) == 1.0
    assert one(spark, text.contains_word(F.lit("La marca Zará, hoy"), F.lit("zara"))) is True
    assert one(spark, text.contains_word(F.lit("Zarandear"), F.lit("zara"))) is False
    assert one(spark, text.contains_word(F.lit("a"), F.lit("a"))) is False
    assert one(spark, text.ordered_distinct(F.array(*map(F.lit, ["A", "b", "a", "B", "c"])), 2)) == ["A", "b"]


def test_hamming_and_bands(spark):
    assert one(spark, hamming(F.lit("0"), F.lit("f"))) == 4
    assert one(spark, hamming(F.lit("ab"), F.lit("abc"))) == 64
    assert one(spark, hamming(F.lit("aa00aa00aa00aa00"), F.lit("aa00aa00aa00aa03"))) == 2
    assert "".join(b.digits for b in one(spark, bands(F.lit("0123456789abcdef")))) == f"{0x0123456789ABCDEF:064b}"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, vectors.cosine_raw(a, a), vectors.cosine_raw(a, b), vectors.cosine_unit(a, b), vectors.cosine_raw(a, F.array(F.lit(0.0), F.lit(0.0))), vectors.cosine_unit(a, F.array(F.lit(1.0)))) == (1.0, 0.0, 0.5, 0.0, None)


def test_hash_embedding_is_unit_or_zero(spark):
    rows = spark.createDataFrame([("red dress",), ("",), (None,)], "t string").select(hash_embedding("t").alias("v")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-12
    assert not any(rows[1].v) and not any(rows[2].v)


def test_hash_embedding_is_signed_fnv(spark):
    def slow(text):
        v = [0.0] * 64
        for word in text.split():
            h = 2166136261
            for ch in word:
                h = (h ^ ord(ch)) * 16777619 % 2**32
            signed = h - 2**32 if h >= 2**31 else h
            v[abs(signed) % 64] += -1 if signed % 2 else 1
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    texts = [r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().collect()]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hash_embedding("t").alias("v")).collect()
    assert all(max(abs(a - b) for a, b in zip(r.v, slow(r.t))) < 1e-12 for r in got)


def test_djb2(spark):
    h = 5381
    for c in "zara":
        h = (h * 33 ^ ord(c)) & 0xFFFFFFFF
    assert one(spark, djb2(F.lit("zara"))) == h


def test_boxes(spark):
    a, b = geometry.box(*map(F.lit, (0.0, 0.0, 0.5, 0.5))), geometry.box(*map(F.lit, (0.25, 0.0, 0.5, 0.5)))
    assert one(spark, geometry.iou(a, b)) == pytest.approx(1 / 3)
    assert one(spark, geometry.valid_box(geometry.box(*map(F.lit, (0.9, 0.0, 0.5, 0.5))))) is False
    assert one(spark, geometry.oversized(geometry.box(*map(F.lit, (0.0, 0.0, 1.0, 0.9))))) is True
    grown = one(spark, geometry.padded(a, 0.1))
    assert (grown.x, grown.y) == (0.0, 0.0) and grown.width == pytest.approx(0.55)
