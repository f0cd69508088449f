"""Which source answers, what a result may claim, and the states that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vcspark.operators.detections import top_per_group

#: Names of modes, retryable states, values that say nothing, providers whose results may be kept.
MODES = ["catalog_only", "catalog_first", "external_only", "catalog_and_external"]
MODE_ALIASES = {
    "catalog-only": "catalog_only", "catalog-first": "catalog_first", "external-only": "external_only", "catalogonly": "catalog_only", "catalogfirst": "catalog_first",
    "externalonly": "external_only", "hybrid": "catalog_and_external", "catalog-and-external": "catalog_and_external", "catalogandexternal": "catalog_and_external",
}
RETRYABLE = ["catalog_timeout", "external_timeout", "matching_error"]
GENERIC_VALUES = ["desconocido", "desconocida", "no identificado", "no identificada", "unknown", "n/a", "na", "none", "generico", "genérico", "generic", "null"]
SAVABLE_PROVIDERS = ["serpapi_google_lens", "searchapi_google_lens", "serpapi_google_shopping", "dataforseo_google_shopping"]
USD_TO_EUR = 0.92


def _map(values: dict[str, str] | dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for p in values.items() for x in p])


def matching_mode(value: Column) -> Column:
    """A mode's canonical name; null for anything else."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(MODES), v).otherwise(F.element_at(_map(MODE_ALIASES), v))


def external_call(mode: Column, enabled: Column, provider: Column, matched: Column, forced: Column, fallback: Column) -> Column:
    """struct(call, status, is_fallback): whether the outside search is asked."""
    out = lambda call, status, is_fallback: F.struct(F.lit(call).alias("call"), F.lit(status).alias("status"), (is_fallback if isinstance(is_fallback, Column) else F.lit(is_fallback)).alias("is_fallback"))
    return (
        F.when(~enabled | ~provider | (mode == "catalog_only"), out(False, "disabled", False))
        .when(mode.isin("external_only", "catalog_and_external"), out(True, "loading", False))
        .when(forced, out(True, "loading", ~matched))
        .when(matched | ~fallback, out(False, "not_requested", False))
        .otherwise(out(True, "loading", True))
    )


def candidate_match_type(source: Column, stage: Column, stated: Column, score: Column, threshold: Column, verified: Column) -> Column:
    """exact only with evidence of identity, probable if reliable, else similar."""
    identity = (source == "catalog") & F.coalesce(stage.isin("exact_hash", "perceptual_hash"), F.lit(False)) | (source == "external") & F.coalesce(stated == "exact", F.lit(False))
    return F.when(~(verified & (score >= threshold)), "similar").when(identity, "exact").otherwise("probable")


def classify_by_source(label: Column, score: Column, source: Column) -> Column:
    return F.when(label.isin("SIMILAR", "NO_MATCH"), "similar").when(score >= F.when(source == "catalog", 0.9).otherwise(0.95), "exact").otherwise("probable")


def product_status(catalog: Column, external: Column) -> Column:
    """A product's state from the states of the two sources' blocks; null blocks are an error."""
    return (
        F.when(catalog.isNull() | external.isNull(), "matching_error")
        .when(catalog == "matched", "catalog_matched")
        .when(external == "matched", "external_candidate")
        .when(catalog == "timeout", "catalog_timeout")
        .when(external == "timeout", "external_timeout")
        .when(catalog == "error", F.when(external == "unresolved", "partial_result").otherwise("matching_error"))
        .when(external == "error", "partial_result")
        .otherwise("no_match")
    )


def category_threshold(category: Column, thresholds: dict[str, float], default: float) -> Column:
    """The threshold of a category, ``default`` where it has none."""
    key = F.lower(F.trim(category))
    return F.coalesce(F.element_at(_map(thresholds), key), F.lit(default)) if thresholds else F.lit(default)


def item_status(match_status: Column) -> Column:
    return F.when(match_status == "catalog_matched", "catalog_matched").when(match_status == "external_candidate", "review_required").otherwise("detected")


def recommendation_type(stated: Column, reason: Column, similarity: Column) -> Column:
    """A recommendation's type: stated, or at the head of its reason, or by similarity."""
    told = F.regexp_extract(F.coalesce(reason, F.lit("")), "^(exact|near_exact|similar) match", 1)
    return F.when(stated.isNotNull(), stated).when(told != "", told).when(similarity >= 0.8, "near_exact").when(similarity.isNotNull(), "similar")


def image_status(crop_url: Column, persistence: Column) -> Column:
    """Where a detected image lives, by the shape of its address."""
    return F.when(F.coalesce(crop_url, F.lit("")) == "", "none").when(crop_url.startswith("data:"), "local_only").when(persistence == "postgres", "synced").otherwise("pending_database_sync")


def known_value(value: Column) -> Column:
    """The trimmed value; null for those that say nothing."""
    v = F.trim(value)
    return F.when((v != "") & ~F.lower(v).isin(GENERIC_VALUES), v)


def enriched(item: dict[str, Column], crop: dict[str, Column], present: Column) -> dict[str, Column]:
    """An item's fields after a closer look at its crop (``present``): the crop's values first, but a known brand yields only to a verified one."""
    brand = known_value(item["visible_brand"])
    visible = F.when(brand.isNotNull() & ~F.coalesce(crop["brand_status"] == "verified", F.lit(False)), brand).otherwise(F.coalesce(crop["visible_brand"], brand))
    status = F.when(visible.isNotNull() & (F.coalesce(crop["brand_status"] == "verified", F.lit(False)) | brand.isNotNull()), "verified").when(visible.isNotNull(), crop["brand_status"]).when(F.coalesce(crop["brand_guess"], item["brand_guess"]).isNotNull(), "probable").otherwise("unknown")
    new = {
        "visible_brand": visible,
        "brand_guess": F.coalesce(crop["brand_guess"], known_value(item["brand_guess"])),
        "color": F.coalesce(crop["color"], item["color"]),
        "pattern": F.coalesce(crop["pattern"], item["pattern"]),
        "logo_visible": crop["logo_visible"] | item["logo_visible"],
        "features": F.slice(F.array_distinct(F.concat(crop["features"], crop["terms"], F.coalesce(item["features"], F.array().cast("array<string>")))), 1, 8),
        "brand_status": status,
    }
    return {name: F.when(present, value).otherwise(item.get(name, F.lit(None))) for name, value in new.items()}


def real_discount(original: Column, price: Column) -> Column:
    """The former price if it is above the present one; anything else is no discount."""
    return F.when(original > price, original)


def recommendations(candidates: DataFrame, item: str, order: list[Column], offers: DataFrame | None = None, offer_order: list[Column] | None = None) -> DataFrame:
    """Recommendations of each item from ranked candidates (score, price, currency, match_type, title): six, or five and three offers.

    Similarity is score / 150, at most 1; offers come after, without similarity or type, so that they never count as identity.
    """
    good = top_per_group(candidates.where("score > 0"), [item], order, 6 if offers is None else 5, "place")
    money = F.coalesce("currency", F.when(F.col("price").isNotNull(), "EUR"))
    out = good.select(item, "place", "title", "price", money.alias("currency"), F.least(F.col("score") / 150, F.lit(1.0)).alias("similarity"), "match_type")
    if offers is None:
        return out
    extra = top_per_group(offers, [item], offer_order or order, 3, "place")
    none = F.lit(None)
    return out.unionByName(extra.select(item, (F.col("place") + 5).alias("place"), "title", "price", F.coalesce("currency", F.lit("EUR")).alias("currency"), none.cast("double").alias("similarity"), none.cast("string").alias("match_type")))


def capturable(label: Column, source: Column, score: Column, image_url: Column, link: Column, provider: Column) -> Column:
    """Whether an outside match is kept for review."""
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    return (label == "EXTERNAL_MATCH") & (source == "external") & (score >= 0.6) & given(image_url) & given(link) & provider.isin(SAVABLE_PROVIDERS)


def commercial_signals(merchant: Column, price: Column, link: Column, image_url: Column) -> Column:
    """Share of four: merchant, price, web address, picture."""
    given = lambda x: (F.coalesce(x, F.lit("")) != "").cast("int")
    return (given(merchant) + price.isNotNull().cast("int") + F.coalesce(link.startswith("http"), F.lit(False)).cast("int") + given(image_url)) / 4


def pipeline_status(allowed: Column, failed: Column, matched: Column, similar: Column) -> Column:
    return F.when(~allowed, "budget_exhausted").when(failed, "provider_error").when(matched, "matched").when(similar > 0, "similar_only").otherwise("no_match")


def connector_status(paused: Column, enabled: Column, agreement: Column, lifecycle: Column, health: Column, implementation: Column, live: Column) -> Column:
    """A connector's state; the order is the policy: law, then technique, then proof."""
    return (
        F.when(paused | ~enabled, "paused")
        .when(agreement | (lifecycle == "partner_required"), "partner_required")
        .when(health == "disallowed", "blocked_by_robots")
        .when(health == "blocked", "blocked_or_challenged")
        .when((implementation == "scaffold") | (lifecycle == "pending"), "pending")
        .when(health == "error", "error")
        .when(live, "implemented_verified")
        .otherwise("implemented_unverified")
    )


def can_sync(enabled: Column, implementation: Column, lifecycle: Column, agreement: Column, credentials: Column) -> Column:
    return enabled & (implementation != "scaffold") & ~lifecycle.isin("pending", "partner_required") & ~agreement & credentials
