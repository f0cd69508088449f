"""Brands and search texts on cases that the tables don't have, against plain code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vcspark.operators import brands, searching


def titles(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, title string")


BRANDED = (
    ["Red Door of the North Men Shirt"] * 4 + ["Turtle Women Top"] * 5 + ["TURTLE Solid Men Tie"] * 4 + ["Lee Men Jeans"] * 4 + ["Lee Cooper Men Shoes"] * 4 + ["Rare Men Hat"] * 3 + ["A Men Hat"] * 4 + [f"{'x' * 29} Men Hat"] * 4
    + [None, "", "  ", "lee  cooper SHOES", "Lee Cooperage Men", "Turtle", "Red Door of Men", "one two three four five Men", "Men Shirt"]
)


@pytest.mark.parametrize("small", [200_000, -1])
def test_brands_of_any_number_of_words(spark, monkeypatch, small):
    monkeypatch.setattr(brands, "BROADCAST_ROWS", small)
    rows = titles(spark, BRANDED)
    listed = brands.allowed_brands(rows, "title")
    assert sorted((r.key, r.brand, r.titles) for r in listed.collect()) == [("lee", "Lee", 4), ("lee cooper", "Lee Cooper", 4), ("turtle", "Turtle", 5)]
    longer = listed.union(spark.createDataFrame([("red door of the north", "Red Door of the North", 5, 4)], listed.schema))
    got = {r.title: (r.brand, r.brand_reason, r.brand_candidate) for r in brands.extract_brands(rows, longer, "title").collect()}
    assert got["Red Door of the North Men Shirt"][:2] == ("Red Door of the North", "allowlist") and got["Red Door of Men"] == (None, "not_in_allowlist", "Red Door of")
    assert got["lee  cooper SHOES"][0] == "Lee Cooper" and got["Lee Cooperage Men"][0] == "Lee" and got["TURTLE Solid Men Tie"][0] == "Turtle"
    assert got[None] == got[""] == got["  "] == (None, "no_title", None) and got["Men Shirt"] == got["one two three four five Men"] == (None, "no_gender_boundary", None)
    assert brands.extract_brands(rows, longer, "title").count() == len(BRANDED)
    assert brands.extract_brands(rows, longer.limit(0), "title").where("brand is not null").count() == 0
    assert brands.allowed_brands(rows, "title", generic=["turtle"]).where("key = 'turtle'").count() == 0


def slow_queries(item):
    def translate(terms, value):
        if not value:
            return None
        key = value.lower().strip()
        return terms.get(key) or next((v for k, v in terms.items() if k in key), value)

    def phrase(*parts):
        return " ".join(" ".join(p for p in parts if p and p.strip()).split())

    brand = item["visible_brand"] or item["brand_guess"] or None
    category, color = translate(searching.CATEGORIES, item["subcategory"] or item["category"]), translate(searching.COLORS, item["color"])
    text = (item["visible_text"] or "").strip() or None
    gender = {"hombre": "men", "mujer": "women"}.get(item["gender_fit"])
    out = []
    if brand and text and text.lower() != brand.lower():
        out.append(phrase(brand, f'"{text}"', category, color))
    if brand:
        out.append(phrase(brand, color, category, gender))
        if item["logo_visible"] and item["logo_description"]:
            seen = item["logo_description"].lower()
            out.append(phrase(brand, color, category, "logo sleeve" if "manga" in seen or "sleeve" in seen else "chest logo" if "pecho" in seen or "chest" in seen else "logo"))
    if not brand and text:
        out.append(phrase(f'"{text}"', category, color))
    out += [item["search_query_es"] or "", phrase(color, category, None if item["pattern"] == "liso" else item["pattern"], gender), *(item["alternative_queries"] or [])]
    first = {}
    for q in out:
        key = " ".join((q or "").lower().split())
        if " " in key:
            first.setdefault(key, q.strip())
    return list(first.values())[:4]


def test_search_queries_equal_plain_code(spark):
    names = "visible_brand brand_guess category subcategory color visible_text gender_fit logo_visible logo_description pattern search_query_es alternative_queries".split()
    rows = [
        ("Zara", "Guess", "camiseta", None, "azul marino", "Just Do", "hombre", True, "Logo en el pecho", "liso", "camiseta azul Zara", ["Zara Camiseta AZUL", "x"]),
        (None, "", "Zapatillas altas", "", "Rojo", " run ", "mujer", True, "manga", "rayas", "", None), ("", None, None, None, None, None, None, None, None, None, None, None),
        ("Zara", None, "gafas de sol", None, "azul marino oscuro", "ZARA", "unisex", False, "chest", None, "una", ["dos palabras", None, " dos  palabras "]), (None, None, "teapot", "vestido", "teal", None, "x", None, "", "liso", None, []),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} {'boolean' if n == 'logo_visible' else 'array<string>' if n.startswith('alt') else 'string'}" for n in names))
    got = {r.id: r.q for r in df.select("id", searching.search_queries({n: F.col(n) for n in names}).alias("q")).collect()}
    assert got == {i: slow_queries(dict(zip(names, r))) for i, r in enumerate(rows)}
