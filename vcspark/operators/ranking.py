"""Outside candidates: additive score, confidence, verified ranking, removal of repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vcspark.functions.text import contains_word, fold_accents

# Points of the additive score, what it is divided by, thresholds, trusted shops, weights of the verified ranking.
POINTS = {
    "exact_image_match": 100, "lens_top_position": 45, "lens_high_position": 25, "lens_result": 10, "same_brand": 50, "visible_text_match": 40,
    "same_color": 15, "same_category": 10, "same_style_gender": 10, "trusted_store": 30, "unknown_store": -20, "has_price": 8,
}
NORMALISER = 150
EXACT, NEAR_EXACT, SIMILAR = 0.9, 0.7, 0.3
TRUSTED = [
    "amazon.es", "amazon.com", "zalando.es", "zalando.com", "asos.com", "elcorteingles.es",
    "nike.com", "adidas.es", "adidas.com", "zara.com", "decathlon.es", "mediamarkt.es",
    "pccomponentes.com", "ikea.com", "leroymerlin.es", "sephora.es", "mango.com", "pullandbear.com",
    "bershka.com", "footlocker.es", "jdsports.es", "sprintersports.com", "veepee.es", "privalia.com",
    "farfetch.com", "mytheresa.com", "net-a-porter.com", "ssense.com", "elpalaciodehierro.com", "ebay.es",
]
VERIFIED_WEIGHTS = {"visual": 0.45, "lens": 0.2, "pattern": 0.15, "brand_text": 0.1, "commercial": 0.05, "merchant": 0.05}


def trusted_domain(domain: Column, brand: Column) -> Column:
    """A trusted shop or its subdomain, or the brand's own address."""
    listed = domain.rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in TRUSTED) + ")$")
    b = F.regexp_replace(F.lower(brand), r"\s+", "")
    own = (b != "") & (domain.startswith(F.concat(b, F.lit("."))) | F.contains(domain, F.concat(F.lit("."), b, F.lit("."))))
    return F.coalesce(listed | F.coalesce(own, F.lit(False)), F.lit(False))


def score_breakdown(c: dict[str, Column]) -> dict[str, Column]:
    """Points by signal from columns exact_image, query_used, position, title, brand, store, domain, price, item_brand, visible_text, colors, categories, styles (arrays of words)."""
    text = F.concat_ws(" ", c["title"], c["brand"], c["store"])
    exact = F.coalesce(c["exact_image"], F.lit(False))
    lens = ~exact & c["query_used"].isNull() & c["position"].isNotNull()
    any_word = lambda words: F.coalesce(F.exists(words, lambda w: contains_word(text, w)), F.lit(False))
    trusted = trusted_domain(c["domain"], c["item_brand"])
    signals = {
        "exact_image_match": exact,
        "lens_top_position": lens & (c["position"] <= 3),
        "lens_high_position": lens & c["position"].between(4, 10),
        "lens_result": lens & (c["position"] > 10),
        "same_brand": contains_word(text, c["item_brand"]),
        "visible_text_match": contains_word(text, c["visible_text"]),
        "same_color": any_word(c["colors"]),
        "same_category": any_word(c["categories"]),
        "same_style_gender": any_word(c["styles"]),
        "trusted_store": trusted,
        "unknown_store": ~trusted,
        "has_price": c["price"].isNotNull(),
    }
    return {k: F.when(v, POINTS[k]).otherwise(0) for k, v in signals.items()}


def match_confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / NORMALISER))


def classify_match(score: Column, b: dict[str, Column]) -> Column:
    """exact, near_exact, similar or null; "exact" needs the same picture."""
    confidence, has = match_confidence(score), lambda k: b[k] != 0
    strong = has("lens_top_position") | has("exact_image_match")
    near = (has("same_brand") & has("visible_text_match")) | ((confidence >= NEAR_EXACT) & (has("same_brand") | (has("visible_text_match") & strong)))
    return F.when(confidence < SIMILAR, None).when(has("exact_image_match") & (confidence >= EXACT), "exact").when(has("exact_image_match") | near, "near_exact").otherwise("similar")


def component_scores(b: dict[str, Column], query_used: Column, price: Column, image_url: Column, commercial_domain: Column) -> dict[str, Column]:
    has = lambda k: b[k] != 0
    lens = F.when(has("exact_image_match"), 1.0).when(has("lens_top_position"), 0.75).when(has("lens_high_position"), 0.5).when(has("lens_result"), 0.3).otherwise(0.0)
    part = lambda k, v: F.when(has(k), v).otherwise(0.0)
    return {
        "lens": F.when(query_used.isNotNull() & ~has("exact_image_match"), F.least(lens, F.lit(0.2))).otherwise(lens),
        "pattern": F.least(F.lit(1.0), part("same_color", 0.4) + part("same_category", 0.35) + part("same_style_gender", 0.25)),
        "brand_text": F.least(F.lit(1.0), part("same_brand", 0.6) + part("visible_text_match", 0.4)),
        "commercial": F.least(F.lit(1.0), F.when(price.isNotNull(), 0.6).otherwise(0.0) + F.when(image_url.isNotNull(), 0.2).otherwise(0.0) + F.when(commercial_domain, 0.2).otherwise(0.0)),
        "merchant": F.when(has("trusted_store"), 1.0).when(has("unknown_store"), 0.2).otherwise(0.5),
    }


def verified_confidence(s: dict[str, Column], similarity: Column, contradictions: Column) -> Column:
    """The weighted sum with a picture comparison, or half the engine's signal without one; contradictions cap it at 0.5 - 0.1 each."""
    visual = F.coalesce(similarity, s["lens"] * 0.5)
    total = visual * VERIFIED_WEIGHTS["visual"] + sum((s[k] * w for k, w in VERIFIED_WEIGHTS.items() if k != "visual"), F.lit(0.0))
    capped = F.when(similarity.isNotNull() & (contradictions > 0), F.least(total, 0.5 - 0.1 * contradictions)).otherwise(total)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped))


def verified_type(confidence: Column, similarity: Column, contradictions: Column, text_only: Column, commercial: Column) -> Column:
    sure = (similarity >= 0.85) & (contradictions == 0) & (confidence >= EXACT) & commercial
    return F.when(confidence < SIMILAR, None).when(text_only, "similar").when(F.coalesce(sure, F.lit(False)), "exact").when(confidence >= NEAR_EXACT, "near_exact").otherwise("similar")


def drop_repeats(candidates: DataFrame, group: str, order: str, link: str = "link", domain: str = "domain", title: str = "title") -> DataFrame:
    """Candidates of each group in ``order`` without those whose link, or domain with title, was among earlier kept ones.

    A row that is dropped leaves no keys behind, so the outcome depends on the order:
    it is a fold over each group. Groups are shuffled together and sorted, and a task
    folds all of its groups in one pass, with the keys of one group in memory. Null
    links equal each other, null orders come last; rows equal in ``order`` go by link,
    domain and title.
    """
    keyed = candidates.withColumn("__t", F.concat_ws("|", F.coalesce(F.col(domain), F.lit("null")), F.lower(fold_accents(F.col(title)))))
    keyed = keyed.repartition(group).sortWithinPartitions(group, F.col(order).asc_nulls_last(), link, domain, title)
    names = candidates.columns

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, links, titles = object(), set(), set()
        for part in parts:
            keep = []
            for g, a, b in zip(part.column(group).to_pylist(), part.column(link).to_pylist(), part.column("__t").to_pylist()):
                if g != now and (g == g or now == now):  # NaN is one group
                    now, links, titles = g, set(), set()
                fresh = a not in links and b not in titles
                keep.append(fresh)
                if fresh:
                    links.add(a)
                    titles.add(b)
            yield part.select(names).filter(pa.array(keep, pa.bool_()))

    return keyed.mapInArrow(fold, candidates.schema)
