"""Brands at the start of titles: an allow-list derived from the titles themselves, pruned, and looked up by first word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vcspark.operators.skew import BROADCAST_ROWS
from vcspark.sources.shared import save_shared

#: Words that end a brand, the words looked at for one, lengths of a brand, least titles.
GENDER_WORDS = ["men", "mens", "men's", "women", "womens", "women's", "woman", "boys", "girls", "unisex", "kids", "kid", "baby", "infant", "for"]
WORDS_SEEN = 5
BRAND_LENGTHS = (2, 28)
LEAST_TITLES = 4
#: Brands that stay although a shorter one starts them.
DISTINCT_BRANDS = ["lee cooper"]


def words_of(title: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")), r"\s+"), lambda w: w != "")


def brand_candidate(title: Column | str) -> Column:
    """The words before the first gender word, which is the second to fifth word; null without one."""
    words = words_of(title)
    cut = F.array_position(F.transform(F.slice(words, 2, WORDS_SEEN - 1), lambda w: F.lower(w).isin(GENDER_WORDS)), F.lit(True))
    return F.when(cut > 0, F.array_join(F.slice(words, 1, cut.cast("int")), " "))


def allowed_brands(titles: DataFrame, title: str, generic: list[str] | None = None, distinct: list[str] | None = None) -> DataFrame:
    """(key, brand, n_words, titles): lower-cased brands of enough titles, without those that a shorter one starts.

    ``generic`` words are no brands; ``distinct`` ones stay beside a shorter one. Of
    spellings that differ in case, the most frequent stands, then the smallest.
    """
    least, most = BRAND_LENGTHS
    spelled = titles.select(brand_candidate(title).alias("brand")).where(F.length("brand").between(least, most)).groupBy("brand").agg(F.count("*").alias("n"))
    frequent = spelled.where(F.col("n") >= LEAST_TITLES).where(~F.lower("brand").isin(generic or [""]))
    brands = frequent.groupBy(F.lower("brand").alias("key")).agg(F.min(F.struct((-F.col("n")).alias("m"), "brand"))["brand"].alias("brand"), F.sum("n").alias("titles"))
    brands = brands.withColumn("n_words", F.size(F.split("key", " ")))
    shorter = F.explode(F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), lambda n: F.array_join(F.slice(F.split("key", " "), 1, n), " ")))
    starts = brands.where("n_words > 1").select("key", shorter.alias("start"))
    covered = starts.join(brands.select(F.col("key").alias("start")), "start", "left_semi").where(~F.col("key").isin(distinct or DISTINCT_BRANDS))
    return brands.join(covered.select("key").distinct(), "key", "left_anti").select("key", "brand", "n_words", "titles")


def extract_brands(titles: DataFrame, brands: DataFrame, title: str) -> DataFrame:
    """``titles`` with brand, brand_reason and brand_candidate: the longest allowed brand whose words start the title.

    A trie of two levels: the first word tells which lengths its brands have, and only
    prefixes of these lengths are looked up, however long. ``brands`` comes from
    ``allowed_brands``. Its rows are counted: a list that isn't small joins by shuffle.
    Reasons: allowlist, not_in_allowlist (there is a candidate, which is reported),
    no_gender_boundary and no_title. ``titles`` needs no key; each row stays one row.
    """
    brands = save_shared(brands.select(F.col("key").alias("__key"), F.col("brand").alias("__brand"), F.col("n_words").alias("__n")), "brands")
    small = brands.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    lengths = brands.groupBy(F.substring_index("__key", " ", 1).alias("__first")).agg(F.sort_array(F.collect_set("__n"), asc=False).alias("__lengths"))
    words = F.transform(words_of(title), F.lower)
    rows = titles.withColumn("__words", words).withColumn("__first", F.get("__words", F.lit(0)))
    known = rows.join(hint(lengths), "__first", "left")
    fitting = F.filter(F.coalesce("__lengths", F.array().cast("array<int>")), lambda n: n <= F.size("__words"))
    keyed = known.withColumn("__prefixes", F.transform(fitting, lambda n: F.array_join(F.slice("__words", 1, n), " ")))
    found = _longest(keyed, brands, small)
    candidate = brand_candidate(title)
    reason = F.when(F.col("__found").isNotNull(), "allowlist").when(F.size("__words") == 0, "no_title").when(candidate.isNull(), "no_gender_boundary").otherwise("not_in_allowlist")
    shown = F.coalesce(F.col("__found"), candidate)
    return found.select(*titles.columns, F.col("__found").alias("brand"), reason.alias("brand_reason"), shown.alias("brand_candidate"))


def _longest(keyed: DataFrame, brands: DataFrame, small: bool) -> DataFrame:
    """``keyed`` with ``__found``, the brand of its first prefix that is one.

    Pruning leaves a first word few lengths, mostly one, so each length is a join of its
    own, and rows stay rows; the number of rounds is that of the longest list of lengths.
    """
    most = keyed.agg(F.max(F.size("__prefixes"))).first()[0] or 0
    out = keyed.withColumn("__found", F.lit(None).cast("string"))
    for i in range(most):
        side = brands.select(F.col("__key").alias(f"__key{i}"), F.col("__brand").alias(f"__hit{i}"))
        out = out.join(F.broadcast(side) if small else side, F.get("__prefixes", F.lit(i)) == F.col(f"__key{i}"), "left").withColumn("__found", F.coalesce("__found", f"__hit{i}"))
    return out
