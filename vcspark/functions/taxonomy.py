"""Colours, categories, families, brands and genders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vcspark.functions.text import norm_strict

# Each canonical colour with the words for it.
COLOURS = {
    "black": ["negro", "black"],
    "white": ["blanco", "white", "off white", "crudo", "ecru"],
    "red": ["rojo", "red"],
    "burgundy": ["burdeos", "burgundy", "granate"],
    "blue": ["azul", "blue"],
    "navy": ["marino", "navy", "azul marino"],
    "light blue": ["celeste", "light blue"],
    "green": ["verde", "green"],
    "khaki": ["caqui", "khaki"],
    "olive": ["oliva", "olive"],
    "yellow": ["amarillo", "yellow"],
    "mustard": ["mostaza", "mustard"],
    "orange": ["naranja", "orange"],
    "pink": ["rosa", "pink"],
    "fuchsia": ["fucsia", "fuchsia"],
    "purple": ["morado", "purple", "violeta"],
    "lilac": ["lila", "lilac"],
    "brown": ["marron", "brown"],
    "camel": ["camel"],
    "beige": ["beige", "arena"],
    "taupe": ["taupe"],
    "grey": ["gris", "grey", "gray"],
    "anthracite": ["antracita", "anthracite"],
    "silver": ["plata", "silver"],
    "gold": ["dorado", "gold"],
    "cream": ["crema", "cream"],
    "multicolor": ["multicolor"],
}

# Families, their canonical categories, and the words for each category.
CATEGORIES = {
    "clothing": {
        "clothing": ["prenda", "prendas", "ropa", "prenda superior", "prenda inferior", "parte superior", "parte inferior", "clothing", "apparel", "garment"],
        "dress": ["vestido", "vestidos", "dress", "dresses", "saree", "sarees", "sari"],
        "t-shirt": ["camiseta", "camisetas", "t shirt", "tshirt", "tee"],
        "shirt": ["camisa", "camisas", "shirt"],
        "blouse": ["blusa", "blouse"],
        "trousers": ["pantalon", "pantalones", "trousers", "pants", "capri", "capris", "leggings", "jeggings"],
        "jeans": ["vaquero", "vaqueros", "jeans", "denim"],
        "skirt": ["falda", "faldas", "skirt"],
        "jacket": ["chaqueta", "chaquetas", "jacket", "cazadora"],
        "blazer": ["blazer", "americana"],
        "coat": ["abrigo", "abrigos", "coat", "parka", "trench", "gabardina"],
        "sweater": ["jersey", "jerseis", "sweater", "punto", "knitwear"],
        "sweatshirt": ["sudadera", "sweatshirt", "hoodie"],
        "cardigan": ["cardigan"],
        "shorts": ["short", "shorts", "bermuda"],
        "top": ["top", "tops", "tunic", "tunics", "kurta", "kurtas", "kurtis"],
        "bodysuit": ["body", "bodysuit"],
        "jumpsuit": ["mono", "jumpsuit"],
        "socks": ["sock", "socks", "calcetines"],
    },
    "footwear": {
        "footwear": ["calzado", "footwear"],
        "shoes": ["zapato", "zapatos", "shoes", "flat", "flats", "mocasin", "loafers"],
        "sneakers": ["zapatilla", "zapatillas", "sneakers", "trainers"],
        "boots": ["bota", "botas", "boots"],
        "sandals": ["sandalia", "sandalias", "sandals", "flip flop", "flip flops", "chanclas"],
        "heels": ["tacon", "heels"],
    },
    "bags_accessories": {
        "bags_accessories": ["accesorio", "accesorios", "complemento", "complementos", "accessory", "accessories"],
        "bag": ["bolso", "bolsos", "bag", "bags", "handbag", "handbags", "clutch", "clutches"],
        "backpack": ["mochila", "backpack"],
        "belt": ["cinturon", "belt"],
        "scarf": ["bufanda", "scarf", "scarves"],
        "cap": ["gorra", "cap"],
        "hat": ["sombrero", "hat"],
        "sunglasses": ["gafas", "sunglasses"],
        "wallet": ["wallet", "wallets", "cartera"],
    },
    "watches_jewelry": {
        "watches_jewelry": ["joyeria", "jewellery"],
        "watch": ["reloj", "watch"],
        "jewelry": ["earring", "earrings", "pendientes", "necklace", "collar", "bracelet", "pulsera", "ring", "anillo", "pendant"],
    },
    "beauty": {
        "fragrance": ["perfume", "fragrance", "colonia", "perfumes", "deodorant", "desodorante"],
        "makeup": ["lipstick", "makeup", "maquillaje", "nail polish", "lip gloss", "mascara", "foundation", "kajal", "eyeshadow"],
    },
}
# Brand spellings that mean another brand, and genders that suit everyone.
BRAND_ALIASES = {"h m": "hm", "h and m": "hm", "hennes mauritz": "hm", "zara home": "zara", "mango outlet": "mango"}
UNISEX = ["unisex", "unisexo", "all", "todos", "mixto", "kids", "nino", "nina"]

COLOUR_WORDS = {word: colour for colour, words in COLOURS.items() for word in words}
CATEGORY_WORDS = {word: category for group in CATEGORIES.values() for category, words in group.items() for word in words}
FAMILIES = {category: family for family, group in CATEGORIES.items() for category in group if category != family}


def literal_map(values: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))


def _lookup(table: Column, key: Column) -> Column:
    return F.try_element_at(table, key)


def _first_known(table: Column, keys: Column) -> Column:
    return F.get(F.filter(F.transform(keys, lambda k: _lookup(table, k)), lambda v: v.isNotNull()), F.lit(0))


def canonical_colour(x: Column | str) -> Column:
    """The canonical colour of the whole text, else of its first known pair of words, else of its first known word, else the text itself; null without text."""
    t, table = norm_strict(x), literal_map(COLOUR_WORDS)
    words = F.split(t, " ")
    pairs = F.transform(F.slice(words, 2, 1_000_000), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
    return F.when(t != "", F.coalesce(_lookup(table, t), _first_known(table, pairs), _first_known(table, words), t))


def singular(word: Column) -> Column:
    """A regular English plural's singular; words of up to three letters stay."""
    return (
        F.when(F.length(word) <= 3, word)
        .when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ch|sh|s|x|z)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def canonical_category(x: Column | str) -> Column:
    """The canonical category of the whole text, of its first known word, or of these as English plurals; else the text itself.

    A family's own name, such as ``bags_accessories``, stands for the family.
    """
    x = F.col(x) if isinstance(x, str) else x
    t, table = norm_strict(x), literal_map(CATEGORY_WORDS)
    words = F.split(t, " ")
    raw = F.lower(F.trim(x))
    return F.when(
        t != "",
        F.when(raw.isin(*CATEGORIES), raw).otherwise(F.coalesce(_lookup(table, t), _first_known(table, words), _lookup(table, singular(t)), _first_known(table, F.transform(words, singular)), t)),
    )


def category_family(category: Column) -> Column:
    """The family of a canonical category; null for families and unknown ones."""
    return _lookup(literal_map(FAMILIES), category)


def categories_match(a: Column | str, b: Column | str) -> Column:
    """Equal once canonical, or one is the other's family; missing and "all" match everything."""
    ca, cb = canonical_category(a), canonical_category(b)
    free = ca.isNull() | cb.isNull() | (ca == "all") | (cb == "all")
    return F.coalesce(free | (ca == cb) | category_family(ca).eqNullSafe(cb) | category_family(cb).eqNullSafe(ca), F.lit(True))


def compatible_categories(canonical: str | None) -> list[str] | None:
    """The canonical categories that match ``canonical``, for a pushed-down filter; None: no filter."""
    if not canonical or canonical == "all":
        return None
    if canonical in FAMILIES:
        return [canonical, FAMILIES[canonical]]
    fine = [c for c, f in FAMILIES.items() if f == canonical]
    return [canonical, *fine] if fine else None


def canonical_brand(x: Column | str) -> Column:
    t = norm_strict(x)
    return F.when(t != "", F.coalesce(_lookup(literal_map(BRAND_ALIASES), t), t))


def identity_key(brand: Column | str, title: Column | str, colour: Column | str) -> Column:
    return F.concat_ws("|", F.coalesce(canonical_brand(brand), F.lit("")), norm_strict(title), F.coalesce(canonical_colour(colour), F.lit("")))


def gender_conflict(a: Column | str, b: Column | str) -> Column:
    """Both known, neither unisex, and different."""
    x, y = norm_strict(a), norm_strict(b)
    return (x != "") & (y != "") & ~x.isin(*UNISEX) & ~y.isin(*UNISEX) & (x != y)
