"""Text, price and address normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters up to U+024F and U+1E00..U+1EFF that decompose into an ASCII letter and marks, and those letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1]
    pairs = [p for p in pairs if p[1].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folding()


def fold_accents(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), "[̀-ͯ]", "")


def norm_basic(x: Column | str) -> Column:
    """Accents folded, lower case, white space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(F.coalesce(x, F.lit("")))), r"\s+", " "))


def norm_strict(x: Column | str) -> Column:
    """``norm_basic`` with everything but a-z, 0-9 and white space turned into a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(F.coalesce(x, F.lit("")))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def tokens(x: Column | str) -> Column:
    """The distinct words of ``norm_strict``."""
    return F.array_distinct(F.filter(F.split(norm_strict(x), " "), lambda t: t != ""))


def contains_word(haystack: Column | str, needle: Column | str) -> Column:
    """Whether ``needle`` (two characters at least) occurs in ``haystack`` between word limits, accents and case aside."""
    pad = lambda x: F.concat(F.lit(" "), F.regexp_replace(F.lower(fold_accents(F.coalesce(x, F.lit("")))), "[^a-z0-9]", " "), F.lit(" "))
    word = F.trim(F.lower(fold_accents(F.coalesce(needle, F.lit("")))))
    return (F.length(word) >= 2) & F.contains(pad(haystack), F.concat(F.lit(" "), F.regexp_replace(word, "[^a-z0-9]", " "), F.lit(" ")))


def text_overlap(query: Column | str, *fields: Column | str) -> Column:
    """Share of the query's distinct words that the fields hold; 0 for a query without words."""
    q = tokens(query)
    held = tokens(F.concat_ws(" ", *fields))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, held)) / F.size(q))


def once(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of the values as fields of one struct, which is evaluated once however often they are used."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), F.lit(0))


def parse_price(x: Column | str) -> Column:
    """A price in European or US notation as a double; null where there is none."""

    def plain(cleaned: Column) -> Column:
        comma = F.length(cleaned) - F.instr(F.reverse(cleaned), ",")
        dot = F.length(cleaned) - F.instr(F.reverse(cleaned), ".")
        comma, dot = F.when(F.contains(cleaned, F.lit(",")), comma).otherwise(-1), F.when(F.contains(cleaned, F.lit(".")), dot).otherwise(-1)
        first_comma = F.regexp_replace(F.replace(cleaned, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")
        return F.when(comma > dot, first_comma).otherwise(F.replace(cleaned, F.lit(","), F.lit("")))

    number = once({"text": F.regexp_replace(x, r"[^\d.,-]", "")}, lambda i: plain(i["text"]))
    return once({"text": number}, lambda i: F.when(i["text"].rlike(r"^-?(\d+\.?\d*|\.\d+)$"), i["text"].try_cast("double")))


#: Currency codes and signs that are taken as they are.
CURRENCIES = ["EUR", "USD", "GBP", "SEK", "PLN", "MXN", "CHF", "DKK", "NOK"]
CURRENCY_SIGNS = {"€": "EUR", "$": "USD", "£": "GBP"}


def currency(x: Column | str) -> Column:
    t = F.upper(F.trim(x))
    out = F.when(t.isin(*CURRENCIES), t)
    for sign, code in CURRENCY_SIGNS.items():
        out = out.when(t == sign, code)
    return out.when(F.length(t) == 3, t)


#: Words of availability texts, in the order in which they are looked for.
IN_STOCK = "instock|in stock|available|disponible|backorder|preorder|limitedavailability"
OUT_OF_STOCK = "outofstock|out of stock|soldout|sold out|agotado|discontinued"


def availability(x: Column | str) -> Column:
    """in_stock, out_of_stock or unknown; words for in stock are looked for first, so "unavailable" is in stock."""
    t = norm_strict(x)
    return F.when(t == "", "unknown").when(t.rlike(IN_STOCK), "in_stock").when(t.rlike(OUT_OF_STOCK), "out_of_stock").otherwise("unknown")


def canonical_url(x: Column | str) -> Column:
    """Scheme, host and path, without query and fragment."""
    return F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)", 1)


def url_domain(x: Column | str) -> Column:
    """The host without ``www.``, lower case; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def host_path_key(x: Column | str) -> Column:
    """Domain and path without a closing slash: the same page whatever its scheme, query or fragment."""
    path = F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(url_domain(x), F.regexp_replace(path, "/+$", ""))


def url_locale(x: Column | str) -> Column:
    """The first path segment that is a two-letter locale; null where there is none."""
    found = F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/(?:[^/?#]+/)*?([a-z]{2})(?=[/?#]|$)", 1)
    return F.when(found != "", found)


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves towards plus infinity, as a double."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def time_bucket(seconds: Column | str, width: int = 5) -> Column:
    """Start of the bucket of ``width`` seconds; negative times fall into the first."""
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.greatest(F.lit(0), F.floor(seconds / width) * width).cast("long")


def ordered_distinct(items: Column, limit: int) -> Column:
    """The first ``limit`` items that differ in more than case, in order."""
    lowered = F.transform(items, lambda x: F.lower(x))
    first = F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.slice(first, 1, limit)


def timestamp(seconds: Column | str) -> Column:
    """Seconds as m:ss, from an hour on as h:mm:ss; negatives are 0."""
    s = F.greatest(F.lit(0), F.floor(seconds))
    hours, minutes = F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int")
    short = F.format_string("%d:%02d", minutes, (s % 60).cast("int"))
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, (s % 60).cast("int"))).otherwise(short)


def section_price(x: Column | str) -> Column:
    """The first number of a result section's price: dots before three digits are thousands, a comma is the decimal sign."""
    number = F.regexp_extract(x, r"([\d.,]+)", 1)
    return F.regexp_replace(F.regexp_replace(number, r"\.(?=\d{3})", ""), "^([^,]*),", "$1.").try_cast("double")


def section_currency(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.contains(x, F.lit("€")), "EUR").when(F.contains(x, F.lit("$")), "USD")
