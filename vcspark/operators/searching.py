"""Search texts for detected items: Spanish terms in English, the most specific text first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vcspark.functions.text import once

# Spanish terms and what they are searched as, looked through in this order.
COLORS = {
    "negro": "black", "blanco": "white", "gris": "grey", "azul": "blue", "rojo": "red", "verde": "green", "amarillo": "yellow", "rosa": "pink",
    "morado": "purple", "violeta": "purple", "marron": "brown", "marrón": "brown", "beige": "beige", "naranja": "orange", "burdeos": "burgundy", "granate": "burgundy",
    "crema": "cream", "dorado": "gold", "plateado": "silver", "denim": "denim", "azul marino": "navy blue", "turquesa": "turquoise", "caqui": "khaki",
}
CATEGORIES = {
    "camiseta": "t-shirt", "sudadera": "hoodie", "pantalon": "trousers", "pantalón": "trousers", "vaqueros": "jeans", "chaqueta": "jacket", "abrigo": "coat",
    "vestido": "dress", "falda": "skirt", "camisa": "shirt", "zapatillas": "sneakers", "zapatos": "shoes", "botas": "boots", "bolso": "bag", "mochila": "backpack",
    "gorra": "cap", "gafas": "sunglasses", "reloj": "watch", "auriculares": "headphones", "ropa": "clothing", "calzado": "footwear", "silla": "chair", "mesa": "table",
    "lampara": "lamp", "lámpara": "lamp", "sofa": "sofa", "sofá": "sofa",
}
GENDERS = {"hombre": "men", "mujer": "women"}
PLAIN_PATTERN = "liso"
MOST_QUERIES = 4


def _given(text: Column) -> Column:
    """Null for an empty text."""
    return F.when(text != "", text)


def translated(text: Column, terms: dict[str, str]) -> Column:
    """The whole text's term, else the first term it contains, else the text itself; null for null and empty."""
    known = F.create_map(*[F.lit(x) for t in terms.items() for x in t])

    def term(key: Column) -> Column:
        held = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(key, t))
        return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.get(held, F.lit(0))))

    return F.when(_given(text).isNotNull(), F.coalesce(once({"key": F.trim(F.lower(text))}, lambda i: term(i["key"])), text))


def _phrase(*parts: Column) -> Column:
    """Parts that aren't blank, single spaces between words."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *[F.when(F.trim(p) != "", p) for p in parts]), r"\s+", " "))


def _texts(i: Column) -> list[Column]:
    brand, text, color, category, gender = i["brand"], i["text"], i["color"], i["category"], i["gender"]
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    logo = F.when(F.regexp_like(i["described"], F.lit("(?i)manga|sleeve")), "logo sleeve").when(F.regexp_like(i["described"], F.lit("(?i)pecho|chest")), "chest logo").otherwise("logo")
    return [
        F.when(brand.isNotNull() & (F.lower(text) != F.lower(brand)), _phrase(brand, quoted, category, color)),
        F.when(brand.isNotNull(), _phrase(brand, color, category, gender)),
        F.when(brand.isNotNull() & i["logo_visible"] & i["described"].isNotNull(), _phrase(brand, color, category, logo)),
        F.when(brand.isNull() & text.isNotNull(), _phrase(quoted, category, color)),
        i["stated"],
        _phrase(color, category, i["pattern"], gender),
    ]


def _first_of_each(i: Column, most: int) -> Column:
    first = F.filter(i["texts"], lambda q, n: (F.array_position(i["plain"], F.get(i["plain"], n)) == n + 1) & F.contains(F.get(i["plain"], n), F.lit(" ")))
    return F.slice(first, 1, most)


def search_queries(item: dict[str, Column], most: int = MOST_QUERIES) -> Column:
    """Up to ``most`` texts for an item, from specific to general, each once up to case and spaces, of two words or more.

    ``item`` has visible_brand, brand_guess, category, subcategory, color, visible_text,
    gender_fit, logo_visible, logo_description, pattern, search_query_es and
    alternative_queries (array). All may be null. Brands are taken as stated, never guessed.
    """
    parts = {
        "brand": F.coalesce(_given(item["visible_brand"]), _given(item["brand_guess"])), "text": _given(F.trim(item["visible_text"])),
        "category": translated(F.coalesce(_given(item["subcategory"]), _given(item["category"])), CATEGORIES), "color": translated(item["color"], COLORS),
        "gender": reduce(lambda chain, t: chain.when(item["gender_fit"] == t[0], t[1]), GENDERS.items(), F), "logo_visible": item["logo_visible"], "described": _given(item["logo_description"]),
        "pattern": F.when(item["pattern"] != PLAIN_PATTERN, item["pattern"]), "stated": _given(item["search_query_es"]), "more": F.coalesce(item["alternative_queries"], F.array().cast("array<string>")),
    }
    every = once(parts, lambda i: F.array_compact(F.transform(F.concat(F.array(*_texts(i)), i["more"]), lambda q: F.trim(q))))
    both = once({"texts": every}, lambda i: F.struct(i["texts"].alias("texts"), F.transform(i["texts"], lambda q: F.lower(F.regexp_replace(q, r"\s+", " "))).alias("plain")))
    return once({"both": both}, lambda i: _first_of_each(i["both"], most))
