"""What models and result sections say, as typed rows: fields by alias, placeholders to null, scales to 0..1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vcspark.functions.text import parse_price, section_currency, section_price, url_domain

#: Words that say that there is nothing to say.
PLACEHOLDER = r"(?i)^(n/?a|null|none|unknown|desconocido|no data)$"


def _text(doc: Column, *paths: str) -> Column:
    """The first of ``paths`` that holds a text, trimmed; empty ones are skipped."""
    values = [F.trim(F.try_variant_get(doc, p, "string")) for p in paths]
    return F.coalesce(*[F.when(v != "", v) for v in values])


def _unit(x: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(default))))


def stated(value: Column) -> Column:
    """A model's text; null for empty ones and placeholders."""
    v = F.trim(value)
    return F.when((v != "") & ~v.rlike(PLACEHOLDER), v)


def section_fields(doc: Column) -> dict[str, Column]:
    """What a row of a result section (a variant) says under its fields' aliases, to be held before ``section_row`` uses it."""
    return {
        "title": _text(doc, "$.title", "$.name"),
        "link": _text(doc, "$.link", "$.url", "$.product_link", "$.source_url"),
        "store": _text(doc, "$.source", "$.merchant.name", "$.seller"),
        "image_url": _text(doc, "$.thumbnail", "$.image.link", "$.image.url", "$.image.src", "$.image_url"),
        "priced": F.coalesce(F.try_variant_get(doc, "$.extracted_price", "string"), F.try_variant_get(doc, "$.price", "string")),
        "whole": F.coalesce(F.schema_of_variant(F.variant_get(doc, "$.price", "variant")).startswith("OBJECT"), F.lit(False)),
        "nested": F.coalesce(F.try_variant_get(doc, "$.price.extracted_value", "double"), F.try_variant_get(doc, "$.price.value", "double")),
        "nested_currency": _text(doc, "$.price.currency"),
        "stated_currency": _text(doc, "$.currency"),
    }


def section_row(f: Column, exact: Column) -> dict[str, Column]:
    """A row of a result section by its ``section_fields`` (a struct); title or link null means that the row is to be discarded."""
    plain = F.when(f["priced"].rlike(r"^-?\d+(\.\d+)?$"), f["priced"].try_cast("double")).otherwise(section_price(f["priced"]))
    return {
        "title": f["title"],
        "link": f["link"],
        "store": F.coalesce(f["store"], url_domain(f["link"])),
        "image_url": f["image_url"],
        "price": F.when(f["whole"], f["nested"]).otherwise(plain),
        "currency": F.coalesce(F.when(f["whole"], f["nested_currency"]).otherwise(section_currency(f["priced"])), f["stated_currency"]),
        "exact": exact,
    }


def recommendation_row(doc: Column) -> dict[str, Column]:
    """A recommended product (a variant): similarity within 0..1 (0.7 if none is stated, above 1 a percentage), price only above 0."""
    similarity = F.coalesce(F.try_variant_get(doc, "$.similarity", "double"), F.lit(0.7))
    price = F.try_variant_get(doc, "$.approx_price_eur", "double")
    return {
        "title": _text(doc, "$.title"),
        "brand": _text(doc, "$.brand"),
        "price": F.when(price > 0, F.round(price, 2)),
        "similarity": _unit(F.when(similarity > 1, similarity / 100).otherwise(similarity), 0.7),
    }


def extraction_fields(doc: Column) -> dict[str, Column]:
    """What a model's extraction (a variant) says, to be held before ``extraction_row`` uses it."""
    said = {"kind": "$.productType", "title": "$.title", "brand": "$.brand", "confidence": "$.confidence"}
    return {name: F.try_variant_get(doc, path, "string") for name, path in said.items()} | {"amount": parse_price(F.try_variant_get(doc, "$.price", "string"))}


def extraction_row(f: Column) -> dict[str, Column]:
    """An extraction by its ``extraction_fields`` (a struct): kind product, listing or unknown, placeholders null, no negative price, confidence within 0..1 (0.5 if none is stated); a listing says nothing of a product."""
    kind = F.when(f["kind"].isin("product", "listing"), f["kind"]).otherwise("unknown")
    own = lambda x: F.when(~f["kind"].eqNullSafe("listing"), x)
    return {
        "kind": kind,
        "title": own(stated(f["title"])),
        "brand": own(stated(f["brand"])),
        "price": own(F.when(f["amount"] >= 0, f["amount"])),
        "confidence": _unit(f["confidence"].try_cast("double"), 0.5),
    }


def best_by_hysteresis(entries: Column, factor: float = 1.15) -> Column:
    """Of a track's crops in order of time (an array of structs with quality and has_box), the one held at the end: another replaces it only if it is better by ``factor``, or if the one held has no box."""
    first, rest = F.get(entries, F.lit(0)), F.slice(entries, 2, 1 << 30)
    return F.aggregate(rest, first, lambda held, new: F.when((new["quality"] > held["quality"] * factor) | ~held["has_box"], new).otherwise(held))


def columns(fields: dict[str, Column]) -> list[Column]:
    return reduce(lambda out, p: [*out, p[1].alias(p[0])], fields.items(), [])


def held(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with the values as columns, each worked out once a row.

    The optimiser puts the expression of a plain column into each filter on it, and there
    into each place that uses it; it doesn't look through an exploded array of one.
    """
    made = F.explode(F.array(F.struct(*columns(values)))).alias("__held")
    return rows.select("*", made).select(*rows.columns, *[F.col("__held")[n].alias(n) for n in values])
