"""Filters, gates and scores of detected items and of the outside candidates found for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vcspark.functions.text import fold_accents

#: Hosts that sell nothing, words of editorial titles, words for priorities and categories.
NON_COMMERCE_HOSTS = ["news.", "wikipedia.", "youtube.", "instagram.", "facebook.", "tiktok.", "pinterest.", "reddit.", "medium."]
NON_COMMERCIAL_DOMAINS = ["pinterest.", "instagram.", "facebook.", "twitter.", "x.com", "tiktok.", "reddit.", "tumblr.", "youtube.", "blogspot.", "wordpress.", "medium.", "wikipedia.", "fandom."]
EDITORIAL_TITLE = r"(?i)\b(news|noticias|biograph(?:y|y)|biograf[ií]a|celebrity|famos[oa]|actor|actress|interview|entrevista|article|art[ií]culo|review|opinion|lookbook|street style)\b"
PLAIN_PATTERN = "(?i)^(liso|plain|solid)$"
HIGH_PRIORITY = [
    "ropa", "camisa", "camiseta", "sudadera", "chaqueta", "pantal", "vestido", "shirt", "hoodie", "jacket", "dress", "t-shirt",
    "reloj", "watch", "joyer", "jewel", "pulsera", "collar", "anillo", "gafas", "glasses", "sunglasses", "bolso", "bag", "mochila", "backpack",
    "zapat", "calzado", "sneaker", "shoe", "bota", "movil", "phone", "portatil", "laptop", "monitor", "camara", "camera", "auricular", "headphone",
    "tablet", "consola", "coche", "car", "moto", "vehic",
]
LOW_PRIORITY = [
    "planta", "plant", "vegetacion", "arbol", "flor", "barandilla", "railing", "valla", "pared", "wall", "techo", "suelo",
    "ventana", "window", "puerta", "door", "columna", "estructura", "edificio", "cesped", "arbusto", "cielo", "montaña",
]
WEARABLE = [
    "camis", "shirt", "sudadera", "hoodie", "chaqueta", "jacket", "pantal", "vestido", "reloj", "watch", "pulsera", "joyer", "gafas", "glasses",
    "zapat", "sneaker", "bolso", "bag", "mochila", "gorra", "sombrero", "cinturon",
]
PREMIUM = [
    "reloj", "watch", "bolso", "bag", "zapat", "sneaker", "calzado", "shoe", "gafas", "glasses", "auricular", "headphone", "móvil", "phone", "portátil",
    "laptop", "cámara", "camera", "joyer", "jewel", "pulsera", "coche", "car",
]
BUYABLE_HIGH = [
    "ropa", "camisa", "camiseta", "calzado", "zapat", "electr", "mueble", "accesorio", "bolso", "reloj", "gafas", "coche", "shirt", "t-shirt", "hoodie",
    "watch", "sneaker", "shoe", "bag", "glasses", "laptop", "monitor", "phone", "camera", "car", "furniture", "electronics", "chair", "headphone",
]
BUYABLE_MID = ["decora", "hogar", "deport", "belleza", "gadget", "mug", "taza", "lamp", "lampara", "bottle", "home", "decor", "sport", "beauty"]
RELATIONSHIP_SCORES = {"worn": 1.0, "held": 0.95, "used": 0.8, "near_person": 0.55, "background": 0.15}
ACCESSORY_CATEGORIES = ["all", "bags_accessories", "footwear", "watches_jewelry"]
UNVALIDATED = ["detected", "external_candidate", "review_required", "ignored"]


def holds_any(hay: Column, words: list[str]) -> Column:
    """Whether ``hay`` contains one of ``words``; one pass of one pattern."""
    quoted = "|".join("".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in w) for w in words)
    return hay.rlike(quoted) if words else F.lit(False)


def optional_filters(df: DataFrame, **conditions: tuple[str, object]) -> DataFrame:
    """``df`` where each named column stands in the given relation to a value; a null value asks nothing.

    Relations are Column methods: ``eqNullSafe``, ``isin``, ``__ge__`` and so on. Each
    condition is its own filter, so that all reach the scan.
    """
    return reduce(lambda d, c: d if c[1][1] is None else d.where(getattr(F.col(c[0]), c[1][0])(c[1][1])), conditions.items(), df)


def null_or_equal(column: Column, asked: Column) -> Column:
    """Whether ``asked`` is null or equals ``column``."""
    return asked.isNull() | (column == asked)


def presentable(primary: Column, images: Column) -> Column:
    """Whether there is a primary image or any image with a URL (an empty string is none)."""
    some = lambda x: x.isNotNull() & (x != "")
    return F.coalesce(some(F.coalesce(primary, F.get(F.filter(images, lambda i: some(i["url"])), F.lit(0))["url"])), F.lit(False))


def dataset_row_wanted(master: Column, sub: Column, gender: Column, categories: list[str], genders: list[str]) -> Column:
    """Whether a row's master or sub category, and its gender, is among those asked for; an empty list asks nothing."""
    category = F.coalesce(F.lower(master).isin([c.lower() for c in categories]), F.lit(False)) | F.coalesce(F.lower(sub).isin([c.lower() for c in categories]), F.lit(False))
    sex = F.coalesce(F.lower(gender), F.lit("")).isin([g.lower() for g in genders])
    return (category if categories else F.lit(True)) & (sex if genders else F.lit(True))


def _hay(category: Column, subcategory: Column, name: Column) -> Column:
    empty = lambda x: F.coalesce(x, F.lit(""))
    return fold_accents(F.lower(F.concat_ws(" ", empty(category), empty(subcategory), empty(name))))


def category_allowed(category: Column, subcategory: Column, name: Column, keywords: dict[str, list[str]], selected: list[str]) -> Column:
    """Whether an item's texts hold a keyword of one of the ``selected`` categories; ``all`` or none selects everything."""
    if not selected or "all" in selected:
        return F.lit(True)
    return holds_any(_hay(category, subcategory, name), [w for c in selected for w in keywords.get(c, [])])


def relationship_allowed(relationship: Column, person_centric: bool, selected: list[str]) -> Column:
    """Whether an item's relation to a person is wanted: background never, worn and used always, others with accessories selected."""
    if not person_centric:
        return F.lit(True)
    accessories = F.lit(any(c in ACCESSORY_CATEGORIES for c in selected))
    rel = F.coalesce(relationship, F.lit("near_person"))
    return F.when(rel == "background", False).when(rel.isin("worn", "used"), True).when(rel.isin("held", "near_person"), accessories).otherwise(True)


def commercial_candidate(link: Column, domain: Column, title: Column, price: Column, store: Column, brand: Column) -> Column:
    """Whether an outside result may be shown as something to buy: a web address of no social or news host, no editorial title, and a price, shop or brand."""
    host = F.lower(F.when(F.coalesce(domain, F.lit("")) != "", domain).otherwise(F.regexp_extract(link, r"^[a-zA-Z]+://([^/:?#]+)", 1)))
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.coalesce(link.rlike("(?i)^https?://[^/]"), F.lit(False)) & ~holds_any(host, NON_COMMERCE_HOSTS) & ~F.coalesce(title, F.lit("")).rlike(EDITORIAL_TITLE) & (price.isNotNull() | given(store) | given(brand))


def result_signals(domain: Column, price: Column, source_type: Column, brand: Column, image_url: Column, exact: Column) -> dict[str, Column]:
    """Whether a provider's result is commercial, useful, and an exact commercial one."""
    plain = F.coalesce(domain, F.lit("")) == ""
    sells = plain | ~holds_any(F.coalesce(domain, F.lit("")), NON_COMMERCIAL_DOMAINS)
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    commercial = sells & (price.isNotNull() | F.coalesce(source_type.isin("products", "shopping"), F.lit(False)) | given(brand))
    return {"commercial": commercial, "useful": commercial | sells & given(image_url), "exact": commercial & F.coalesce(exact, F.lit(False))}


def result_quality(results: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """Counts of useful, commercial and exact results, their quality and whether and why to try another provider, by ``keys``."""
    signals = result_signals(**columns)
    counted = results.groupBy(*keys).agg(F.count("*").alias("results"), *[F.count_if(c).alias(f"{n}_count") for n, c in signals.items()])
    quality = F.least(F.lit(1.0), F.col("commercial_count") * 0.15 + F.col("exact_count") * 0.4 + F.col("useful_count") * 0.05)
    reason = F.when(F.col("results") == 0, "no_results").when(F.col("useful_count") < 1, "no_useful_results").when(quality < 0.25, "weak_results")
    return counted.select(*keys, "useful_count", "commercial_count", "exact_count", F.round(quality, 6).alias("quality"), reason.isNotNull().alias("should_fallback"), reason.alias("fallback_reason"))


def presentation_priority(category: Column, subcategory: Column, name: Column, relationship: Column, relevance: Column) -> Column:
    """high, medium or low: what a person wears, holds or uses first, then by words of the texts."""
    hay = _hay(category, subcategory, name)
    low = F.coalesce(relationship == "background", F.lit(False)) | holds_any(hay, LOW_PRIORITY)
    rescued = F.when(F.coalesce(relevance, F.lit(0.0)) >= 0.75, "medium").otherwise("low")
    return F.when(F.coalesce(relationship.isin("worn", "held", "used"), F.lit(False)), "high").when(low, rescued).when(holds_any(hay, HIGH_PRIORITY), "high").otherwise("medium")


def deserves_auto_search(priority: Column, relationship: Column, match_background: bool = False) -> Column:
    near = F.coalesce(relationship.isin("worn", "held", "used"), F.lit(False))
    hidden = F.lit(not match_background) & F.coalesce(relationship == "background", F.lit(False))
    return near | ~hidden & (priority != "low")


def distinctive_pattern(pattern: Column) -> Column:
    return (F.coalesce(pattern, F.lit("")) != "") & ~F.coalesce(pattern, F.lit("")).rlike(PLAIN_PATTERN)


def premium_item(category: Column, subcategory: Column, visible_brand: Column, logo: Column, visible_text: Column, pattern: Column, confidence: Column, relevance: Column) -> Column:
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    words = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(subcategory, F.lit(""))))
    return holds_any(words, PREMIUM) | given(visible_brand) | F.coalesce(logo, F.lit(False)) & (confidence >= 0.6) | given(visible_text) | distinctive_pattern(pattern) | (F.coalesce(relevance, F.lit(0.0)) >= 0.85)


def should_enrich(priority: Column, premium: Column, pattern: Column, visible_text: Column, logo: Column, visible_brand: Column, relevance: Column) -> Column:
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    signal = distinctive_pattern(pattern) | given(visible_text) | F.coalesce(logo, F.lit(False)) | given(visible_brand) | (F.coalesce(relevance, F.lit(0.0)) >= 0.7)
    return (priority != "low") & (premium | (priority == "high") | signal)


def person_association(score: Column, relationship: Column, category: Column, subcategory: Column, name: Column) -> Column:
    """0 to 1: the stated score, else by relation, else by words."""
    by_relation = F.element_at(F.create_map(*[F.lit(x) for p in RELATIONSHIP_SCORES.items() for x in p]), relationship)
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).when(relationship.isNotNull(), by_relation).when(holds_any(_hay(category, subcategory, name), WEARABLE), 0.9).otherwise(0.5)


def buyability(category: Column) -> Column:
    c = F.lower(category)
    return F.when(holds_any(c, BUYABLE_HIGH), 1.0).when(holds_any(c, BUYABLE_MID), 0.7).otherwise(0.5)


def composite_score(association: Column, relevance: Column, area: Column, confidence: Column, distinctive: Column, relationship: Column, priority: Column) -> Column:
    """Person-centred score of an item: association, relevance, visibility, distinctiveness, less for the background."""
    visibility = F.least(F.lit(1.0), area * 4) * confidence
    penalty = F.when(F.coalesce(relationship == "background", F.lit(False)) | (priority == "low"), -0.3).otherwise(0.0)
    return association * 0.45 + relevance * 0.25 + visibility * 0.2 + F.when(distinctive, 1.0).otherwise(0.3) * 0.1 + penalty


def fallback_needed(detections: DataFrame, frames: DataFrame, key: str, wanted: list[Column], low: float = 0.45) -> DataFrame:
    """(key, needed) for each of ``frames``: no detection, only unsure ones, or a wanted category (a condition on detections) without any."""
    missing = reduce(lambda a, b: a | b, [~F.max(w) for w in wanted], F.lit(False))
    found = detections.groupBy(key).agg((F.max("confidence") < low).alias("unsure"), missing.alias("missing"))
    return frames.select(key).join(found, key, "left").select(key, (F.col("unsure").isNull() | F.col("unsure") | F.col("missing")).alias("needed"))


def with_fallback(primary: DataFrame, fallback: DataFrame, frame: str, category: str) -> DataFrame:
    """``primary`` and those rows of ``fallback`` whose category the frame's primary rows lack."""
    norm = F.lower(F.trim(F.col(category)))
    seen = primary.select(F.col(frame).alias("__f"), norm.alias("__c")).distinct()
    extra = fallback.withColumn("__n", norm).join(seen, (F.col(frame) == F.col("__f")) & (F.col("__n") == F.col("__c")), "left_anti").drop("__n")
    return primary.unionByName(extra)


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def evidence_lines(points: Column, labels: Column, most: int = 7) -> Column:
    """Labels of the keys of a map (key to points) that count, most points first, each once."""
    entries = F.filter(F.map_entries(points), lambda e: e["value"] != 0)
    ordered = F.array_sort(F.transform(entries, lambda e, i: F.struct((-e["value"]).alias("p"), i.alias("i"), F.coalesce(F.element_at(labels, e["key"]), e["key"]).alias("label"))))
    return F.slice(F.array_distinct(F.transform(ordered, lambda e: e["label"])), 1, most)


def validated(status: Column) -> Column:
    """Whether an item stands for a real product of the catalogue."""
    return ~status.isin(UNVALIDATED)
