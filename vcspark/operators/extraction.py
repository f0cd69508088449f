"""Product fields of web pages: layers from a Python table function's work, merged by priority."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Layers from strong to weak with what each is trusted; fields a product must have, and those it should.
TRUST = {"feed": 1.0, "sitemap": 0.9, "json_ld": 0.97, "embedded": 0.93, "microdata": 0.9, "open_graph": 0.85, "selectors": 0.9, "dom": 0.6, "url": 0.75, "rendered": 0.9, "model": 0.7}
LAYERS = list(TRUST)
ESSENTIAL, DESIRABLE = ["title", "price", "currency", "image"], ["brand", "color", "category", "availability", "description"]
SNIPPET = 240

_META = re.compile(r"""(?is)<meta\b[^>]*?\b(?:property|name|itemprop)\s*=\s*["']([^"']+)["'][^>]*?\bcontent\s*=\s*["']([^"']*)["']""")
_LD = re.compile(r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)(?:</script>|\Z)""")
_NEXT = re.compile(r"""(?is)<script\b[^>]*\bid\s*=\s*["']__NEXT_DATA__["'][^>]*>(.*?)</script>""")
_ITEM = re.compile(r"""(?is)<[a-z0-9]+\b[^>]*?\bitemprop\s*=\s*["']([^"']+)["'][^>]*>([^<]*)""")
_OG = {"og:title": "title", "og:description": "description", "og:image": "image", "og:site_name": "merchant", "product:price:amount": "price", "product:price:currency": "currency", "product:brand": "brand", "product:availability": "availability"}
_PROPS = {"name": "title", "price": "price", "priceCurrency": "currency", "brand": "brand", "image": "image", "description": "description", "sku": "sku", "availability": "availability", "category": "category", "color": "color", "gtin13": "gtin"}


def balanced_json(text: str, start: int = 0) -> str | None:
    """The first object or array from ``start`` on whose brackets close, strings aside."""
    depth, quoted, escaped, begin = 0, False, False, -1
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = begin >= 0
        elif c in "{[":
            begin, depth = (i if begin < 0 else begin), depth + 1
        elif c in "}]" and begin >= 0:
            depth -= 1
            if not depth:
                return text[begin : i + 1]
    return None


def salvaged_json(text: str) -> str | None:
    """The first object or array of ``text`` with what is broken at its end taken off, or None without one.

    A stack holds the open brackets. Where the text breaks off, or a bracket closes that isn't
    open, all after the last whole value is dropped and the open brackets are closed; commas
    before a closing bracket go. A number or word right at the break counts as broken.
    """
    found = re.search(r"[{\[]", text)
    if not found:
        return None
    kept: list[str] = []
    begin = whole = found.start()
    stack: list[str] = []
    quoted, i, comma = False, begin, -1
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            quoted = c != '"'
        elif c == '"':
            quoted, comma = True, -1
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            whole, comma = i + 1, -1
        elif c in "}]":
            if stack[-1] != c:
                break
            if comma >= 0:
                kept.append(text[begin:comma])
                begin = comma + 1
            stack.pop()
            whole, comma = i + 1, -1
            if not stack:
                break
        elif c == ",":
            whole, comma = i, i
        elif not c.isspace():
            comma = -1
        i += 1
    return "".join([*kept, text[begin:whole], *reversed(stack)])


def _loaded(text: str) -> object:
    """Parsed JSON from ``text``: its first whole object or array, else what can be saved of it; None without any."""
    for cut in (balanced_json, salvaged_json):
        found = cut(text)
        if found:
            try:
                return json.loads(found)
            except (ValueError, RecursionError):
                continue
    return None


def _products(value: object) -> Iterator[dict]:
    if isinstance(value, list):
        for v in value:
            yield from _products(v)
    elif isinstance(value, dict):
        kind = value.get("@type")
        if kind == "Product" or isinstance(kind, list) and "Product" in kind:
            yield value
        for key in ("@graph", "mainEntity", "itemListElement"):
            if key in value:
                yield from _products(value[key])


def _flat(value: object) -> str | None:
    if isinstance(value, list):
        return _flat(value[0]) if value else None
    if isinstance(value, dict):
        return _flat(value.get("name") or value.get("url"))
    return None if value is None or value == "" else str(value)


def layers_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(layer, field, value) of everything a page says about its product."""
    for m in _LD.finditer(page):
        for product in _products(_loaded(m[1])):
            offer = product.get("offers")
            offer = offer[0] if isinstance(offer, list) and offer else offer
            merged = product | ({k: offer[k] for k in ("price", "priceCurrency", "availability") if k in offer} if isinstance(offer, dict) else {})
            for key, field in _PROPS.items():
                if (v := _flat(merged.get(key))) is not None:
                    yield "json_ld", field, v
    if m := _NEXT.search(page):
        try:
            props = json.loads(m[1]).get("props", {}).get("pageProps", {})
            product = props.get("product") if isinstance(props, dict) else None
        except (ValueError, AttributeError):
            product = None
        for key, field in _PROPS.items():
            if isinstance(product, dict) and (v := _flat(product.get(key))) is not None:
                yield "embedded", field, v
    for name, value in _META.findall(page):
        if name.lower() in _OG and value:
            yield "open_graph", _OG[name.lower()], html.unescape(value)
    for name, value in _ITEM.findall(page):
        if name in _PROPS and value.strip():
            yield "microdata", _PROPS[name], html.unescape(value.strip())
    for pattern, field in ((r"(?is)<h1\b[^>]*>(.*?)</h1>", "title"), (r"(?is)<title\b[^>]*>(.*?)</title>", "title")):
        if (m := re.search(pattern, page)) and (v := html.unescape(re.sub(r"<[^>]*>", "", m[1])).strip()):
            yield "dom", field, v
            break


def page_layers(pages: DataFrame) -> DataFrame:
    """(page_id, url, layer, priority, pos, field, value) of all pages (page_id, url, html); ``pos`` is the order in the page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, u, layer, LAYERS.index(layer), n, field, value) for i, u, h in zip(part.page_id, part.url, part.html) for n, (layer, field, value) in enumerate(layers_of(h or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "url", "layer", "priority", "pos", "field", "value"])

    named = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")  # pandas would make null and large numbers doubles
    found = named.mapInPandas(run, "page_id string, url string, layer string, priority int, pos int, field string, value string")
    return found.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def strongest_layers(layers: DataFrame, keys: list[str], field: str, value: str, priority: str) -> DataFrame:
    """Per key and field the value of the layer with the smallest priority; ties go to the smaller value."""
    order = Window.partitionBy(*keys, field).orderBy(priority, value)
    return layers.where(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def merge_layers(layers: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key from (keys, layer, field, value) and, where there are, pos, confidence, snippet.

    Of each field the first present value of the strongest layer stays: by place in ``LAYERS``
    (unknown layers last, by name), then ``pos``, then the smaller value. Null and blank values
    and the product type ``unknown`` aren't present. ``fields`` is a map; ``evidence`` lists
    field, layer, snippet (the first 240 characters of the snippet or value) and confidence (the
    row's, else the layer's) in that order; ``confidence`` is their mean over the nine essential
    and desirable fields, absent ones as 0, to two places. Null keys make a group like others;
    keys without any present value get no row.
    """
    known = {f.name for f in layers.schema}
    trust = F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])
    place = F.coalesce(F.create_map(*[F.lit(x) for pair in zip(LAYERS, range(len(LAYERS))) for x in pair])[F.col("layer")], F.lit(len(LAYERS)))
    given = lambda name, kind: F.col(name).cast(kind) if name in known else F.lit(None).cast(kind)
    sure = F.coalesce(given("confidence", "double"), trust[F.col("layer")], F.lit(0.0))
    rows = layers.where((F.trim("value") != "") & ~((F.col("field") == "product_type") & (F.col("value") == "unknown"))).select(
        *keys,
        "field",
        F.struct(place.alias("place"), F.col("layer"), F.coalesce(given("pos", "long"), F.lit(0)).alias("pos"), "value").alias("o"),
        F.struct(sure.alias("confidence"), F.substring(F.coalesce(given("snippet", "string"), F.col("value")), 1, SNIPPET).alias("snippet")).alias("w"),
    )
    best = rows.groupBy(*keys, "field").agg(F.min_by(F.struct("o", "w"), F.struct("o", "w")).alias("b"))
    one = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("b.o.place").alias("place"), F.col("b.o.layer").alias("layer"), F.col("b.o.pos").alias("pos"), "field", F.col("b.o.value").alias("value"), F.col("b.w").alias("w")))).alias("all"))
    evidence = F.transform("all", lambda x: F.struct(x.field.alias("field"), x.layer.alias("layer"), x.w.snippet.alias("snippet"), x.w.confidence.alias("confidence")))
    merged = one.withColumn("fields", F.map_from_entries(F.transform("all", lambda x: F.struct(x.field, x.value)))).withColumn("evidence", evidence)
    scores = F.map_from_entries(F.transform("evidence", lambda e: F.struct(e.field, e.confidence)))
    wanted = [*ESSENTIAL, *DESIRABLE]
    total = sum((F.coalesce(F.try_element_at("s", F.lit(f)), F.lit(0.0)) for f in wanted), F.lit(0.0))
    return merged.withColumn("s", scores).withColumn("confidence", F.floor(total / len(wanted) * 100 + 0.5) / 100).drop("all", "s")


def needs_escalation(fields: Column) -> Column:
    """Whether an array of found fields lacks an essential one, or three desirable ones."""
    lack = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), fields))
    return (lack(ESSENTIAL) > 0) | (lack(DESIRABLE) >= 3)
