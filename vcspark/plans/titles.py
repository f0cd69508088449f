"""Queries on titles and search texts: brands by a derived allow-list, and search queries for items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.operators import brands, searching
from vcspark.plans.entities import sql, view
from vcspark.plans.registry import query, table

# Titles of products as shops write them: some words of a brand, for whom, what it is.
_TITLE = """CASE WHEN p_size = 13 THEN NULL WHEN p_size = 14 THEN '  ' ELSE
  CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || '  Studio Paris North' WHEN 2 THEN 'Lee Cooper' WHEN 3 THEN 'Lee' WHEN 4 THEN replace(p_name, ' ', ' and ') ELSE p_name END
  || CASE p_size % 5 WHEN 0 THEN ' Men' WHEN 1 THEN ' Women''s' WHEN 2 THEN ' unisex' WHEN 3 THEN '' ELSE ' for' END || ' ' || lower(p_type) END"""
_GENDER = ", ".join("'" + w.replace("'", "''") + "'" for w in brands.GENDER_WORDS)

_BRANDS_SQL = rf"""
WITH t AS (
  SELECT p_partkey, {_TITLE} AS title FROM part
), w AS (
  SELECT p_partkey, title, list_filter(regexp_split_to_array(coalesce(title, ''), '\s+'), lambda x: x <> '') AS words FROM t
), c AS (
  SELECT *, list_position(list_transform(words[2:5], lambda x: lower(x) IN ({_GENDER})), true) AS cut FROM w
), d AS (
  SELECT *, CASE WHEN cut > 0 THEN array_to_string(words[1:cut], ' ') END AS candidate FROM c
), spelled AS (
  SELECT candidate AS brand, count(*) AS n FROM d WHERE length(candidate) BETWEEN 2 AND 28 GROUP BY 1 HAVING count(*) >= 4
), listed AS (
  SELECT lower(brand) AS key, arg_min(brand, (-n, brand)) AS brand FROM spelled GROUP BY 1
), pruned AS (
  SELECT * FROM listed l WHERE key = 'lee cooper' OR NOT EXISTS (SELECT 1 FROM listed s WHERE starts_with(l.key, s.key || ' '))
), matched AS (
  SELECT d.p_partkey, arg_max(b.brand, length(b.key)) AS brand
  FROM d JOIN pruned b ON starts_with(lower(array_to_string(words, ' ')) || ' ', b.key || ' ') GROUP BY 1
)
SELECT p_partkey, m.brand, CASE WHEN m.brand IS NOT NULL THEN 'allowlist' WHEN len(words) = 0 THEN 'no_title' WHEN candidate IS NULL THEN 'no_gender_boundary' ELSE 'not_in_allowlist' END AS brand_reason,
  coalesce(m.brand, candidate) AS brand_candidate
FROM d LEFT JOIN matched m USING (p_partkey)
"""


@query(_BRANDS_SQL)
def title_brands(spark: SparkSession, d: str) -> DataFrame:
    """The brand that starts each title, by the allow-list that the same titles give."""
    titles = table(spark, d, "part").select("p_partkey", F.expr(_TITLE).alias("title"))
    return brands.extract_brands(titles, brands.allowed_brands(titles, "title"), "title").drop("title")


_ITEM = """job_id, item_no, CASE WHEN item_no % 2 = 0 THEN visible_brand END AS visible_brand, CASE WHEN job_id % 3 = 0 THEN brand WHEN job_id % 3 = 1 THEN '' END AS brand_guess,
  CASE job_id % 5 WHEN 0 THEN 'Zapatillas' WHEN 1 THEN 'una camisa larga' WHEN 2 THEN category WHEN 3 THEN 'gafas de sol' END AS category, CASE WHEN job_id % 4 = 0 THEN subcategory END AS subcategory,
  CASE item_no WHEN 1 THEN 'Azul marino' WHEN 2 THEN 'azul marino claro' WHEN 3 THEN 'teal' WHEN 4 THEN ' ROJO ' WHEN 5 THEN '' END AS color,
  CASE WHEN job_id % 7 = 0 THEN brand WHEN job_id % 7 < 4 THEN ' ' || name || ' ' WHEN job_id % 7 = 4 THEN '  ' END AS visible_text,
  CASE job_id % 4 WHEN 0 THEN 'hombre' WHEN 1 THEN 'mujer' WHEN 2 THEN 'unisex' END AS gender_fit, logo_visible,
  CASE item_no % 4 WHEN 0 THEN 'logo en la MANGA' WHEN 1 THEN 'on the chest' WHEN 2 THEN 'round' END AS logo_description, CASE WHEN pattern = 'Plain' THEN 'liso' ELSE pattern END AS pattern,
  CASE WHEN item_no % 3 = 0 THEN name WHEN item_no % 3 = 1 THEN 'zapato' END AS search_query_es, name AS other"""


def _lookup(terms: dict[str, str], value: str) -> str:
    whole = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in terms.items())
    held = " ".join(f"WHEN contains(trim(lower({value})), '{k}') THEN '{v}'" for k, v in terms.items())
    return f"CASE WHEN coalesce({value}, '') = '' THEN NULL ELSE coalesce(CASE trim(lower({value})) {whole} END, CASE {held} END, {value}) END"


def _joined(*parts: str) -> str:
    blank_free = ", ".join(f"coalesce({p}, '')" for p in parts)
    return f"trim(regexp_replace(array_to_string(list_filter([{blank_free}], lambda p: trim(p) <> ''), ' '), '\\s+', ' ', 'g'))"


_QUERIES_SQL = f"""+ i AS (
  SELECT {_ITEM} FROM items
), e AS (
  SELECT *, coalesce(nullif(visible_brand, ''), nullif(brand_guess, '')) AS b, {_lookup(searching.CATEGORIES, "coalesce(nullif(subcategory, ''), nullif(category, ''))")} AS cat, {_lookup(searching.COLORS, "color")} AS col,
    nullif(trim(visible_text), '') AS t, CASE gender_fit WHEN 'hombre' THEN 'men' WHEN 'mujer' THEN 'women' END AS g,
    CASE WHEN regexp_matches(logo_description, '(?i)manga|sleeve') THEN 'logo sleeve' WHEN regexp_matches(logo_description, '(?i)pecho|chest') THEN 'chest logo' ELSE 'logo' END AS hint
  FROM i
), a AS (
  SELECT job_id, item_no, list_transform([
    CASE WHEN b IS NOT NULL AND lower(t) <> lower(b) THEN {_joined("b", "'\"' || t || '\"'", "cat", "col")} END,
    CASE WHEN b IS NOT NULL THEN {_joined("b", "col", "cat", "g")} END,
    CASE WHEN b IS NOT NULL AND logo_visible AND coalesce(logo_description, '') <> '' THEN {_joined("b", "col", "cat", "hint")} END,
    CASE WHEN b IS NULL AND t IS NOT NULL THEN {_joined("'\"' || t || '\"'", "cat", "col")} END,
    nullif(search_query_es, ''), {_joined("col", "cat", "CASE WHEN pattern <> 'liso' THEN pattern END", "g")}, other, 'Outfit  ' || other], lambda q: trim(q)) AS qs
  FROM e
), f AS (
  SELECT job_id, item_no, list_filter(qs, lambda q: q IS NOT NULL) AS qs FROM a
), p AS (
  SELECT job_id, item_no, qs, list_transform(qs, lambda q: lower(regexp_replace(q, '\\s+', ' ', 'g'))) AS plain FROM f
)
SELECT job_id, item_no, array_to_string(list_filter(qs, lambda q, k: list_position(plain, plain[k]) = k AND contains(plain[k], ' '))[1:4], ' | ') AS queries FROM p
"""


@query(sql(_QUERIES_SQL, "items"))
def item_search_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search texts for each item, from specific to general."""
    rows = view(spark, d, "items").selectExpr(*[p.strip() for p in _split(_ITEM)])
    item = {c: F.col(c) for c in rows.columns} | {"alternative_queries": F.array(F.col("other"), F.concat(F.lit("Outfit  "), F.col("other")))}
    return rows.select("job_id", "item_no", F.array_join(searching.search_queries(item), " | ").alias("queries"))


def _split(columns: str) -> list[str]:
    """The columns of a SELECT list; commas inside them don't occur."""
    return columns.split(",")
