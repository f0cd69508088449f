"""Links of shops and videos, styles and fingerprints as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vcspark.functions.text import norm_basic

#: Words of each style, the first group that has one counts.
STYLES = {
    "streetwear": ["street", "urban", "hype", "skate"],
    "luxury": ["luxury", "lujo", "premium", "elegant", "elegante", "high-end"],
    "minimal": ["minimal", "minimalista", "clean", "scandi", "nordic"],
    "sport": ["sport", "deport", "fitness", "gym", "running", "athletic"],
    "tech": ["tech", "tecnolog", "gadget", "setup", "desk"],
    "gamer": ["gamer", "gaming", "rgb", "esport"],
    "outdoor": ["outdoor", "aventura", "hiking", "trekking", "camping", "monta"],
    "formal": ["formal", "business", "office", "traje", "elegant office"],
    "home decor": ["home", "decor", "decora", "interior", "hogar", "furniture", "mueble"],
    "casual": ["casual", "everyday", "relaxed", "diario"],
}
YOUTUBE_HOSTS = ["youtube.com", "m.youtube.com", "youtube-nocookie.com", "music.youtube.com"]


def style_bucket(x: Column) -> Column:
    """The style that the text's words stand for; null if none does."""
    s = F.lower(x)
    choose = reduce(lambda w, p: w.when(s.rlike("|".join(p[1])), p[0]), STYLES.items(), F.when(F.lit(False), F.lit("")))
    return F.when(x.isNotNull(), choose)


def _with_scheme(x: Column) -> Column:
    raw = F.trim(x)
    return F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def youtube_id(x: Column) -> Column:
    """The id of a YouTube video: bare, or from a link of one of its shapes; null for anything else."""
    raw, url = F.trim(x), _with_scheme(x)
    host = _host(url)
    path = F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+/*([^?#]*)", 1)
    asked = F.regexp_extract(url, r"[?&]v=([^&#]*)", 1)
    named = F.regexp_extract(path, "^(?:shorts|embed|live|v)/+([^/]+)", 1)
    valid = lambda v: F.when(v.rlike("^[a-zA-Z0-9_-]{11}$"), v)
    own = F.when(host == "youtu.be", valid(F.regexp_extract(path, "^([^/]+)", 1))).when(host.isin(YOUTUBE_HOSTS), F.coalesce(valid(asked), valid(named)))
    return F.coalesce(valid(raw), own)


def video_provider(x: Column) -> Column:
    """youtube or vimeo, by the link's host; null for anything else."""
    host = _host(_with_scheme(x))
    return F.when(host.isin("youtu.be", *YOUTUBE_HOSTS), "youtube").when(host.isin("vimeo.com", "player.vimeo.com"), "vimeo")


def item_fingerprint(video: Column, name: Column, category: Column, colour: Column, style: Column, brand: Column, bucket: Column) -> Column:
    """What an item is told again by: video, four words of its name, its attributes and its time bucket."""
    or_else = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
    short = F.array_join(F.slice(F.split(norm_basic(name), " "), 1, 4), " ")
    parts = [F.trim(video), or_else(short, "_"), or_else(norm_basic(category), "general"), *(or_else(norm_basic(x), "_") for x in (colour, style, brand)), bucket.cast("string")]
    return F.concat_ws("|", *parts)


#: Words of each type of item, in the order in which they are looked for.
ITEM_TYPES = {
    "footwear": ["zapat", "calzado", "sneaker", "zapatilla", "bota", "shoe", "footwear", "sandalia", "tacon"],
    "accessory": ["reloj", "gafas", "bolso", "mochila", "gorra", "cinturon", "accesorio", "watch", "sunglasses", "bag", "backpack", "hat", "cap", "joya", "collar", "pulsera"],
    "electronics": ["electr", "gadget", "portatil", "laptop", "movil", "phone", "tablet", "auricular", "headphone", "camara", "camera", "tv", "consola", "console", "tech"],
    "home": ["mueble", "furniture", "lampara", "lamp", "silla", "chair", "sofa", "decora", "decor", "hogar", "home", "cocina", "botella", "utensilio"],
    "beauty": ["belleza", "beauty", "cosm", "maquillaje", "makeup", "perfume", "skincare"],
    "clothing": ["ropa", "camiseta", "camisa", "sudadera", "chaqueta", "pantalon", "vaquero", "jean", "short", "vestido"],
}


def item_type(category: Column, subcategory: Column, hint: Column) -> Column:
    """The type that a hint names, else the first whose words the texts hold, else other."""
    told = norm_basic(hint)
    hay = F.concat_ws(" ", norm_basic(category), norm_basic(subcategory), told)
    choose = reduce(lambda w, p: w.when(hay.rlike("|".join(p[1])), p[0]), ITEM_TYPES.items(), F.when(told.isin(*ITEM_TYPES, "other"), told))
    return choose.otherwise("other")


def search_link(base: str, words: Column) -> Column:
    """A search address; a space is %20."""
    return F.concat(F.lit(base), F.replace(F.url_encode(words), F.lit("+"), F.lit("%20")))


def model_json(raw: Column) -> Column:
    """A model's answer as a variant: without code fences and trailing commas, from the first brace to the last; null if that is no JSON."""
    bare = F.regexp_replace(raw, "```[a-zA-Z]*", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.try_parse_json(F.regexp_replace(body, r",\s*([}\]])", "$1"))


def unit_scale(x: Column) -> Column:
    """A confidence within 0 to 1; above 1 it is taken as a percentage."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x)))
