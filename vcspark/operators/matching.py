"""Product match: candidate scores by picture, text and attributes, filters, and the ranked result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vcspark.functions.hashing import hamming, hex_half
from vcspark.functions.taxonomy import canonical_brand, canonical_category, canonical_colour, categories_match, category_family
from vcspark.functions.text import norm_strict, tokens
from vcspark.operators.nearest import nearest
from vcspark.operators.scoring import best_matches
from vcspark.sources.shared import save_shared

# Weights of picture, text and attributes, by what the query has; defaults of the result.
WEIGHTS = {"both": (0.6, 0.25, 0.15), "image": (0.85, 0.0, 0.15), "text": (0.0, 0.8, 0.2)}
MIN_IMAGE_SCORE, MIN_TEXT_SCORE, TOP_K, MOST_K, HASH_DISTANCE, TIE_BAND = 0.82, 0.35, 10, 50, 6, 0.005
BLOCK_QUERIES = 100_000


def visual_score(query_sha: Column, shas: Column, query_hash: Column, product_hash: Column, similarity: Column) -> Column:
    """A struct (score, stage): equal picture 1, near perceptual hash 1 - d / 64, else the cosine from 0; null where nothing compares."""
    d = F.when((F.length(query_hash) > 0) & (F.length(product_hash) > 0), hamming(query_hash, product_hash))
    stages = F.when((query_sha != "") & F.coalesce(F.array_contains(shas, query_sha), F.lit(False)), F.struct(F.lit(1.0).alias("score"), F.lit("exact_hash").alias("stage")))
    stages = stages.when(d <= HASH_DISTANCE, F.struct((1 - d / 64).alias("score"), F.lit("perceptual_hash").alias("stage")))
    return stages.when(similarity.isNotNull(), F.struct(F.greatest(F.lit(0.0), similarity).alias("score"), F.lit("embedding").alias("stage")))


def attribute_score(checks: list[tuple[Column, Column]]) -> Column:
    """Share of the checks (applies, holds) that hold, of those that apply; 0.5 if none does."""
    applies = sum((F.coalesce(a, F.lit(False)).cast("int") for a, _ in checks), F.lit(0))
    holds = sum((F.coalesce(a & h, F.lit(False)).cast("int") for a, h in checks), F.lit(0))
    return F.when(applies == 0, 0.5).otherwise(holds / applies)


def attribute_checks(p: dict[str, Column], q: dict[str, Column]) -> list[tuple[Column, Column]]:
    """Category, brand, colour, type, material and pattern; the last two only where the product states them."""
    hay = norm_strict(F.concat_ws(" ", p["subcategory"], p["style"], p["title"]))
    any_needle = F.exists(tokens(q["type"]), lambda t: F.contains(hay, t))
    colour = canonical_colour(q["color"])
    others = F.exists(F.coalesce(p["secondary_colors"], F.array().cast("array<string>")), lambda c: canonical_colour(c) == colour)
    said = lambda c: c.isNotNull() & (c != "")
    return [
        (said(q["category"]), categories_match(p["category"], q["category"])),
        (said(q["brand"]), canonical_brand(p["brand"]).eqNullSafe(canonical_brand(q["brand"]))),
        (said(q["color"]), canonical_colour(p["color"]).eqNullSafe(colour) | others),
        (said(q["type"]), any_needle),
        (said(q["material"]) & said(p["material"]), norm_strict(p["material"]) == norm_strict(q["material"])),
        (said(q["pattern"]) & said(p["pattern"]), norm_strict(p["pattern"]) == norm_strict(q["pattern"])),
    ]


def image_quality(images: Column) -> Column:
    """(shorter side - 200) / 600 of the first picture of known size, within 0..1; 0.5 without one."""
    first = F.get(F.filter(images, lambda i: (F.coalesce(i["width"], F.lit(0)) > 0) & (F.coalesce(i["height"], F.lit(0)) > 0)), F.lit(0))
    side = F.least(first["width"], first["height"])
    return F.when(first.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (side - 200) / 600)))


def combine_scores(visual: Column, text: Column, attribute: Column, has_image: Column, has_text: Column) -> Column:
    mode = {k: v * visual + t * text + a * attribute for k, (v, t, a) in ((k, tuple(map(F.lit, w))) for k, w in WEIGHTS.items())}
    return F.when(has_image & has_text, mode["both"]).when(has_image, mode["image"]).otherwise(mode["text"])


def rank_matches(scored: DataFrame, query: str, item: str, k: int = TOP_K, least: float = MIN_IMAGE_SCORE) -> DataFrame:
    """The ``k`` (50 at most) best rows of each query with final_score from ``least`` on, with rank.

    Scores within a band of 0.005 count as equal; then image quality (0.5 if there is
    no such column), the score itself and the smaller id decide: a total order.
    Null scores take no part. Keeps at most ``k`` rows of a query in each task before
    the shuffle.
    """
    quality = F.col("image_quality") if "image_quality" in scored.columns else F.lit(0.5)
    order = Window.partitionBy(query).orderBy(F.desc(F.floor(F.col("final_score") / TIE_BAND)), F.desc(quality), F.desc("final_score"), item)
    return scored.where(F.col("final_score") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(k, MOST_K))


def match_products(queries: DataFrame, products: DataFrame, k: int = TOP_K, least: float = MIN_IMAGE_SCORE, digits: int = 4) -> DataFrame:
    """(query_id, product_id, visual_score, text_score, attribute_score, stage, final_score, image_quality, rank): the full product match.

    ``queries``: query_id, image_sha256, perceptual_hash, embedding, query_text,
    text_embedding, category, brand, color, type, gender, material, pattern,
    require_image (null: a query with a picture wants products with one).
    ``products``: product_id, is_active, images (url, sha256, width, height),
    primary_image, perceptual_hash, embedding, text_embedding, brand, title, category,
    subcategory, style, color, secondary_colors, gender, material, pattern.

    Category and brand filter as well as score; gender filters where both state it. A
    query's picture compares by equal file, near hash or vector, and products that
    can't be compared drop out. Both sides are prepared once a row; blocks of them meet
    in tasks, which score the pairs that fit and return a block's best.
    """
    col = F.col
    said = lambda x: F.coalesce(col(x), F.lit("")) != ""

    def prepared(side: DataFrame) -> list[Column]:
        """What is compared of either side, so that no text is normalised for a pair."""
        vectors = [F.col(n) if t in ("array<float>", "array<double>") else F.col(n).cast("array<double>") for n, t in side.select("embedding", "text_embedding").dtypes]
        category = canonical_category("category")
        return [
            category.alias("cat"), category_family(category).alias("fam"), canonical_brand("brand").alias("brand"), canonical_colour("color").alias("color"), norm_strict("gender").alias("gender"),
            *[F.when(said(n), norm_strict(n)).alias(n) for n in ("material", "pattern")], *[F.coalesce(hex_half("perceptual_hash", at), F.lit(0)).alias(f"h{at}") for at in (1, 9)], F.length("perceptual_hash").alias("digits"),
            *[v.alias(n) for n, v in zip(("v", "tv"), vectors)],
        ]

    has_image = said("image_sha256") | said("perceptual_hash") | col("embedding").isNotNull()
    asked = [said(n).alias(f"asks_{n}") for n in ("category", "brand", "color", "type", "material", "pattern")]
    q = queries.select(
        "query_id", F.when(said("image_sha256"), col("image_sha256")).alias("image_sha256"), has_image.alias("has_image"), (F.coalesce(F.trim("query_text"), F.lit("")) != "").alias("has_text"), F.coalesce("require_image", has_image).alias("needs"), tokens("query_text").alias("words"), tokens("type").alias("type"), *asked, *prepared(queries),
    )
    some = F.exists("images", lambda i: F.coalesce(i["url"], F.lit("")) != "")
    colours = F.transform(F.coalesce("secondary_colors", F.array().cast("array<string>")), canonical_colour)
    p = products.where("is_active").select(
        "product_id", (said("primary_image") | F.coalesce(some, F.lit(False))).alias("shown"), F.transform("images", lambda i: i["sha256"]).alias("shas"), F.round(image_quality(col("images")), digits).alias("image_quality"),
        tokens(F.concat_ws(" ", "brand", "title", "category", "color")).alias("words"), norm_strict(F.concat_ws(" ", "subcategory", "style", "title")).alias("hay"), colours.alias("colors"), *prepared(products),
    )
    q, p = save_shared(q, "match-queries"), save_shared(p, "match-products")
    met = best_matches(q, p, WEIGHTS, min(k, MOST_K), least, TIE_BAND, HASH_DISTANCE, digits)
    names = {"visual": "visual_score", "text": "text_score", "attribute": "attribute_score", "stage": "stage", "final": "final_score"}
    scored = met.select("query_id", "product_id", *[(F.col(n) if n == "stage" else F.round(n, digits)).alias(name) for n, name in names.items()], "image_quality")
    return rank_matches(scored, "query_id", "product_id", k, least)


def match_vectors(queries: DataFrame, products: DataFrame, k: int = TOP_K, least: float = MIN_IMAGE_SCORE, digits: int = 4) -> DataFrame:
    """(query_id, product_id, visual_score, final_score, rank) by picture vectors within compatible categories.

    Blocks of queries and of products meet in tasks, which multiply them and return a
    block's best; vectors of different length are not compared. Scores are rounded to ``digits``.
    """
    weight, base = WEIGHTS["image"][0], WEIGHTS["image"][2] * 1.0
    met = nearest(queries, products, min(k, MOST_K), weight, base, least, digits)
    scored = met.select("query_id", "product_id", F.round("visual", digits).alias("visual_score"), F.round(weight * F.col("visual") + base, digits).alias("final_score"))
    return rank_matches(scored, "query_id", "product_id", k, least)


def match_vectors_in_blocks(queries: DataFrame, products: DataFrame, k: int = TOP_K, least: float = MIN_IMAGE_SCORE, block: int = BLOCK_QUERIES) -> DataFrame:
    """``match_vectors`` in about ``block`` queries at a time, dealt by the hash of the id, against all products."""
    blocks = max(1, -(-queries.count() // block))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [match_vectors(queries.where(part == b), products, k, least) for b in range(blocks)])
