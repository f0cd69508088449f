"""Catalogue queries: lookups, normalisation, matching, duplicates, merges.

``part`` stands for products, ``embeddings`` for their picture vectors, ``lineitem``
for sightings and price points, ``orders`` for jobs, ``supplier`` for shops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vcspark.functions import taxonomy, text, vectors
from vcspark.functions.hashing import hamming, hash_embedding, sha256_key
from vcspark.operators import dedup, matching, ranking, upserts
from vcspark.operators.overlap import overlap_topk
from vcspark.plans.entities import view
from vcspark.plans.registry import query, table
from vcspark.sources.shared import save_shared

_STRICT = "trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _strict(x: str) -> str:
    return _STRICT.format(x)


def _sql_map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _products(spark: SparkSession, d: str) -> DataFrame:
    """part with the vector of the same number."""
    vec = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return table(spark, d, "part").join(vec, F.col("p_partkey") == F.col("vec_id"))


_MATCH = """
WITH p AS (SELECT p_partkey, p_type, embedding AS v, label FROM part JOIN embeddings ON vec_id = p_partkey),
q AS (SELECT p_partkey AS query_id, p_type AS qc, v AS qv FROM p WHERE p_partkey % 50 = 0),
s AS (
  SELECT query_id, p_partkey AS product_id,
    greatest(0, list_sum(list_transform(list_zip(qv, v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
      / (sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))))) AS visual
  FROM p JOIN q ON {on}
), f AS (SELECT query_id, product_id, round(visual, 4) AS visual_score, round(0.85 * visual + 0.15, 4) AS final_score FROM s)
SELECT query_id, product_id, visual_score, final_score,
  row_number() OVER (PARTITION BY query_id ORDER BY floor(final_score / 0.005) DESC, final_score DESC, product_id)::INTEGER AS rank
FROM f WHERE final_score >= 0.2 QUALIFY rank <= {k}
"""


def _match(spark: SparkSession, d: str, k: int, filtered: bool) -> DataFrame:
    """Every product whose id is divisible by 50 as a query, in blocks, against all products."""
    products = _products(spark, d)
    kind = F.col("p_type") if filtered else F.lit(None).cast("string")
    asked = products.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("embedding").alias("vector"), kind.alias("category"))
    searched = products.select(F.col("p_partkey").alias("product_id"), F.col("embedding").alias("vector"), kind.alias("category"))
    return matching.match_vectors_in_blocks(asked, searched, k=k, least=0.2)


@query(_MATCH.format(on="true", k=10))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, 10, False)


@query(_MATCH.format(on="p_type = qc", k=5))
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, 5, True)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_partkey = 42").select("p_partkey", "p_name", "p_brand")


@query("SELECT k.l_orderkey, k.l_linenumber, p.p_name FROM lineitem k JOIN part p ON p.p_partkey = k.l_partkey WHERE k.l_returnflag = 'R' AND k.l_quantity >= 49")
def key_lookup_batch(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49")
    return keys.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def filtered_page(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice >= 100000")
    return kept.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, (SELECT count(*) FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 1000000)) AS page_rows")
def page_total(spark: SparkSession, d: str) -> DataFrame:
    """The true total even where the page is out of range."""
    kept = table(spark, d, "orders").where("o_orderstatus = 'F'")
    page = kept.orderBy("o_orderkey").offset(1_000_000).limit(20)
    counted = kept.agg(F.count("*").alias("n")).withColumn("what", F.lit("total")).union(page.agg(F.count("*")).withColumn("what", F.lit("page_rows")))
    return counted.agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("total", "page_rows")])


@query(f"SELECT doc_id, {_strict('text')} AS norm FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.norm_strict("text").alias("norm"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS norm FROM documents")
def normalize_basic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.norm_basic("text").alias("norm"))


_COLOURS = ["Azul Marino", "NAVY", "rojo intenso", "Off-White", "crudo", "gris claro", "verde botella", "  ", "negro/blanco", "desconocido", "azul marino intenso", "Morado"]
_CATEGORIES = ["Vestidos", "Zapatillas deportivas", "T-Shirt", "prenda superior", "accesorio", "bags_accessories", "Perfume and Body Mist", "Watches", "Sarees", "widgets", "Dresses", "bodies", "watches_jewelry"]


def _pick(values: list[str], key: str) -> Column:
    return F.array(*map(F.lit, values))[F.pmod(F.col(key), F.lit(len(values))).cast("int")]


def _sql_pick(values: list[str], key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({key} % {len(values)})::INTEGER + 1]"


@query(
    f"""
WITH r AS (SELECT p_partkey, {_sql_pick(_COLOURS, "p_partkey")} AS raw, {_sql_map(taxonomy.COLOUR_WORDS)} AS m FROM part),
t AS (SELECT *, {_strict("raw")} AS t FROM r), w AS (SELECT *, string_split(t, ' ') AS words FROM t)
SELECT p_partkey, raw, CASE WHEN t <> '' THEN coalesce(m[t],
  list_filter(list_transform(range(1, len(words)), lambda i: m[words[i] || ' ' || words[i + 1]]), lambda v: v IS NOT NULL)[1],
  list_filter(list_transform(words, lambda x: m[x]), lambda v: v IS NOT NULL)[1], t) END AS colour
FROM w
"""
)
def colour_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", _pick(_COLOURS, "p_partkey").alias("raw")).withColumn("colour", taxonomy.canonical_colour("raw"))


_SINGULAR = "CASE WHEN length({0}) <= 3 THEN {0} WHEN {0} LIKE '%ies' THEN {0}[:-4] || 'y' WHEN regexp_matches({0}, '(ch|sh|s|x|z)es$') THEN {0}[:-3] WHEN {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN {0}[:-2] ELSE {0} END"


@query(
    f"""
WITH r AS (SELECT p_partkey, {_sql_pick(_CATEGORIES, "p_partkey")} AS raw, {_sql_map(taxonomy.CATEGORY_WORDS)} AS m, {_sql_map(taxonomy.FAMILIES)} AS f FROM part),
t AS (SELECT *, {_strict("raw")} AS t FROM r), w AS (SELECT *, string_split(t, ' ') AS words FROM t),
c AS (SELECT p_partkey, raw, f, CASE WHEN t <> '' THEN CASE WHEN lower(raw) IN ({", ".join(repr(x) for x in taxonomy.CATEGORIES)}) THEN lower(raw) ELSE coalesce(m[t],
  list_filter(list_transform(words, lambda x: m[x]), lambda v: v IS NOT NULL)[1], m[{_SINGULAR.format("t")}],
  list_filter(list_transform(words, lambda x: m[{_SINGULAR.format("x")}]), lambda v: v IS NOT NULL)[1], t) END END AS category FROM w)
SELECT p_partkey, raw, category, f[category] AS family FROM c
"""
)
def category_canonical(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select("p_partkey", _pick(_CATEGORIES, "p_partkey").alias("raw")).withColumn("category", taxonomy.canonical_category("raw"))
    return named.withColumn("family", taxonomy.category_family(F.col("category")))


@query(
    """
WITH r AS (SELECT o_orderkey, o_totalprice, o_orderkey % 4 AS k,
  CASE o_orderkey % 4 WHEN 0 THEN printf('%.2f €', o_totalprice) WHEN 1 THEN '$' || format('{:,.2f}', o_totalprice)
    WHEN 2 THEN replace(printf('%.2f', o_totalprice), '.', ',') || ' EUR' ELSE 'sin precio' END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN k = 3 THEN NULL ELSE round(o_totalprice, 2) END AS price, CASE k WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END AS currency FROM r
"""
)
def price_parse(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey") % 4, F.col("o_totalprice")
    raw = F.when(k == 0, F.format_string("%.2f €", p)).when(k == 1, F.concat(F.lit("$"), F.format_number(p, 2))).when(k == 2, F.concat(F.replace(F.format_string("%.2f", p), F.lit("."), F.lit(",")), F.lit(" EUR"))).otherwise("sin precio")
    sign = F.when(k == 0, "€").when(k == 1, "$").when(k == 2, " eur ")
    return table(spark, d, "orders").select("o_orderkey", F.round(text.parse_price(raw), 2).alias("price"), text.currency(sign).alias("currency"))


@query(
    r"""
SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)', 1) AS canonical,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS domain,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '')
    || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS page_key
FROM pages
"""
)
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.canonical_url("url").alias("canonical"), text.url_domain("url").alias("domain"), text.host_path_key("url").alias("page_key"))


@query(
    r"""
SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*\blang="([a-zA-Z-]+)"', 1) AS lang,
  regexp_extract(html, '(?i)<meta[^>]*\bcharset="([^"]+)"', 1) AS charset, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1))::INTEGER AS links
FROM pages
"""
)
def page_title_meta(spark: SparkSession, d: str) -> DataFrame:
    get = lambda pattern: F.regexp_extract("html", pattern, 1)
    links = F.size(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)))
    return table(spark, d, "pages").select("page_id", get(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), get(r'(?i)<html[^>]*\blang="([a-zA-Z-]+)"').alias("lang"), get(r'(?i)<meta[^>]*\bcharset="([^"]+)"').alias("charset"), links.alias("links"))


@query("""
WITH h AS (SELECT l_orderkey * 8 + l_linenumber AS id, md5(l_shipdate::DATE::VARCHAR) AS m, l_returnflag FROM lineitem),
k AS (SELECT id, min(substr(m, 1, 13) || '00' || CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '3' ELSE '7' END) AS hash FROM h GROUP BY id),
c AS (SELECT hash, min(id) AS rep, ('0x' || substr(hash, 1, 8))::BIGINT AS a, ('0x' || substr(hash, 9, 8))::BIGINT AS b FROM k GROUP BY hash)
SELECT rep AS left_id, id AS right_id, 0 AS distance FROM k JOIN c USING (hash) WHERE id <> rep
UNION ALL SELECT x.rep, y.rep, (bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)))::INTEGER
FROM c x JOIN c y ON x.rep < y.rep AND bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)) <= 6
""")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs among the hashes of all sightings: membership of classes, and pairs of their representatives."""
    hashes = _sighting_hashes(spark, d).groupBy("id").agg(F.min("hash").alias("hash"))
    return dedup.near_hash_groups(save_shared(hashes, "sighting-hashes"))


def _sighting_hashes(spark: SparkSession, d: str) -> DataFrame:
    """(id, hash): perceptual-like hashes of all sightings."""
    digest = F.md5(F.date_format("l_shipdate", "yyyy-MM-dd"))
    end = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "3").otherwise("7")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.concat(F.substring(digest, 1, 13), F.lit("00"), end).alias("hash"))


@query(
    """
SELECT h AS text_hash, min(doc_id) AS keep_id, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h HAVING count(*) > 1
"""
)
def exact_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT lower(p_brand).replace('#', ' ') || '|' || p_name || '|' || '' AS identity, min(p_partkey) AS keep_id, count(*) AS n FROM part GROUP BY 1")
def identity_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    key = taxonomy.identity_key("p_brand", "p_name", F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", key.alias("identity")).groupBy("identity").agg(F.min("p_partkey").alias("keep_id"), F.count("*").alias("n"))


@query(
    """
WITH p AS (SELECT p_partkey AS id, 's' || p_partkey % 3 AS source, p_partkey // 3 AS spid, 'http://x/' || p_partkey // 2 AS url, md5(p_name || p_size) AS sha, 'k' || p_retailprice AS sku, p_brand, p_name,
    md5(p_brand) AS h, ('0x' || substr(md5(p_brand), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(p_brand), 9, 7) || (p_size % 8))::BIGINT AS h2, embedding AS e FROM part LEFT JOIN embeddings ON vec_id = p_partkey),
c AS (SELECT * FROM p WHERE id % 5 = 1), b AS (SELECT * FROM p WHERE id % 5 <> 1),
g AS (SELECT c.id AS ci, b.id AS bi, c.h1 AS ch1, c.h2 AS ch2, b.h1 AS bh1, b.h2 AS bh2, c.e AS ce, b.e AS be, c.p_brand = b.p_brand AND c.p_name = b.p_name AS same FROM c JOIN b ON NOT (c.source = b.source AND c.spid <> b.spid AND c.sku <> b.sku)),
m AS (
  SELECT c.id AS candidate_id, b.id AS product_id, 0 AS n FROM c JOIN b ON c.source = b.source AND c.spid = b.spid
  UNION ALL SELECT c.id, b.id, 1 FROM c JOIN b ON c.url = b.url UNION ALL SELECT c.id, b.id, 2 FROM c JOIN b ON c.sha = b.sha
  UNION ALL SELECT c.id, b.id, 3 FROM c JOIN b ON c.sku = b.sku
  UNION ALL SELECT ci, bi, 4 FROM g WHERE bit_count(xor(ch1, bh1)) + bit_count(xor(ch2, bh2)) <= 6 AND ci % 4 = 0 AND bi % 4 = 0
  UNION ALL SELECT ci, bi, 5 FROM g WHERE ce IS NOT NULL AND be IS NOT NULL AND list_sum(list_transform(list_zip(ce, be), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
      / (sqrt(list_sum(list_transform(ce, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(be, lambda x: x::DOUBLE * x::DOUBLE)))) >= 0.96
  UNION ALL SELECT ci, bi, 6 FROM g WHERE same
)
SELECT candidate_id, arg_min(product_id, n * 1000000000::BIGINT + product_id) AS product_id,
  ['source_product_id', 'canonical_url', 'exact_image_hash', 'sku_gtin', 'perceptual_hash', 'embedding', 'brand_title_color'][min(n) + 1] AS level FROM m GROUP BY candidate_id
"""
)
def dedup_ladder(spark: SparkSession, d: str) -> DataFrame:
    """All levels: a quarter of the products has a perceptual hash, those with a vector of their number have an embedding."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    near = F.concat(F.substring(F.md5("p_brand"), 1, 15), (F.col("p_size") % 8).cast("string"))
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    products = table(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.floor(k / 3).cast("string").alias("source_product_id"), F.concat(F.lit("http://x/"), F.floor(k / 2).cast("string")).alias("canonical_url"),
        F.md5(F.concat("p_name", F.col("p_size").cast("string"))).alias("image_sha256"), F.concat(F.lit("k"), F.col("p_retailprice").cast("string")).alias("sku"), none.alias("gtin"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), none.alias("color"), F.when(k % 4 == 0, near).alias("perceptual_hash"),
    ).join(vec, "id", "left")
    return dedup.find_duplicates(products.where("id % 5 = 1"), products.where("id % 5 <> 1"))


_COS = "list_sum(list_transform(list_zip(qv, v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))))"


@query(
    f"""
WITH p AS (SELECT p_partkey AS id, p_name, p_brand, lower(p_type) AS kind, p_size, md5(p_name || p_size) AS sha, ('0x' || substr(md5(p_name), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(p_name), 9, 7) || (p_size % 8))::BIGINT AS h2, embedding AS v,
    CASE p_size % 3 WHEN 0 THEN 'women' WHEN 1 THEN 'men' END AS sex FROM part JOIN embeddings ON vec_id = p_partkey),
q AS (SELECT id AS query_id, sha AS qsha, h1 AS q1, h2 AS q2, v AS qv, CASE WHEN id % 3 > 0 THEN p_name END AS words, CASE WHEN id % 4 > 0 THEN kind END AS qkind, CASE WHEN id % 350 = 0 THEN p_brand END AS qbrand, sex AS qsex, split_part(p_name, ' ', 2) AS qtype FROM p WHERE id % 50 = 0),
g AS (SELECT * FROM p JOIN q ON (qkind IS NULL OR kind = qkind) AND (qbrand IS NULL OR p_brand = qbrand) AND p_size % 7 > 0 AND NOT coalesce(sex <> qsex, false)),
s AS (SELECT query_id, id AS product_id, CASE WHEN sha = qsha THEN 1.0 WHEN bit_count(xor(h1, q1)) + bit_count(xor(h2, q2)) <= 6 THEN 1 - (bit_count(xor(h1, q1)) + bit_count(xor(h2, q2))) / 64 ELSE greatest(0, {_COS}) END::DOUBLE AS vs,
    CASE WHEN sha = qsha THEN 'exact_hash' WHEN bit_count(xor(h1, q1)) + bit_count(xor(h2, q2)) <= 6 THEN 'perceptual_hash' ELSE 'embedding' END AS stage, words IS NOT NULL AS has_text,
    CASE WHEN words IS NULL THEN 0 ELSE len(list_filter(string_split(words, ' '), lambda t: list_contains(string_split(lower(replace(p_brand, '#', ' ')) || ' ' || p_name || ' ' || kind, ' '), t))) / len(string_split(words, ' ')) END AS ts,
    ((qkind IS NOT NULL)::INT + (qbrand IS NOT NULL)::INT + contains(p_name, qtype)::INT) / ((qkind IS NOT NULL)::INT + (qbrand IS NOT NULL)::INT + 1) AS attr, greatest(0, least(1, (p_size * 20 - 200) / 600)) AS quality FROM g),
f AS (SELECT query_id, product_id, round(vs, 4) AS visual_score, round(ts, 4) AS text_score, round(attr, 4) AS attribute_score, stage, round(CASE WHEN has_text THEN 0.6::DOUBLE * vs + 0.25::DOUBLE * ts + 0.15::DOUBLE * attr ELSE 0.85::DOUBLE * vs + 0.15::DOUBLE * attr END, 4) AS final_score, round(quality, 4) AS image_quality FROM s)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(final_score / 0.005) DESC, image_quality DESC, final_score DESC, product_id)::INTEGER AS rank FROM f WHERE final_score >= 0.35 QUALIFY rank <= 10
"""
)
def full_product_match(spark: SparkSession, d: str) -> DataFrame:
    """The whole match: picture cascade, words, attributes, filters, quality and tie band; every product whose id is divisible by 50 is a query."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    near = F.concat(F.substring(F.md5("p_name"), 1, 15), (F.col("p_size") % 8).cast("string"))
    sha, sex = F.md5(F.concat("p_name", F.col("p_size").cast("string"))), F.when(F.col("p_size") % 3 == 0, "women").when(F.col("p_size") % 3 == 1, "men")
    picture = F.struct(F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("http://i/"), k)).alias("url"), sha.alias("sha256"), (F.col("p_size") * 20).alias("width"), (F.col("p_size") * 30).alias("height"))
    rows = _products(spark, d)
    products = rows.select(
        k.alias("product_id"), F.lit(True).alias("is_active"), F.array(picture).alias("images"), none.alias("primary_image"), near.alias("perceptual_hash"), "embedding", F.lit(None).cast("array<float>").alias("text_embedding"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"),
        F.lower("p_type").alias("category"), none.alias("subcategory"), none.alias("style"), none.alias("color"), F.lit(None).cast("array<string>").alias("secondary_colors"), sex.alias("gender"), none.alias("material"), none.alias("pattern"),
    )
    queries = rows.where("p_partkey % 50 = 0").select(
        k.alias("query_id"), sha.alias("image_sha256"), near.alias("perceptual_hash"), "embedding", F.when(k % 3 > 0, F.col("p_name")).alias("query_text"), F.lit(None).cast("array<float>").alias("text_embedding"), F.when(k % 4 > 0, F.lower("p_type")).alias("category"),
        F.when(k % 350 == 0, F.col("p_brand")).alias("brand"), none.alias("color"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("type"), sex.alias("gender"), none.alias("material"), none.alias("pattern"), F.lit(None).cast("boolean").alias("require_image"),
    )
    return matching.match_products(queries, products, least=matching.MIN_TEXT_SCORE)


@query(
    f"""
WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split({_strict("text")}, ' '), lambda t: t <> ''))) AS w FROM benchmark),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
p AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split({_strict("text")}, ' '), lambda t: t <> ''))) AS w FROM documents),
s AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 4) AS overlap FROM q JOIN p USING (w) JOIN n USING (item_id) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 3
"""
)
def text_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return _text_overlap(spark, d, table(spark, d, "documents"))


def _text_overlap(spark: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    """The three of ``docs`` that hold most of each query text's words, counted in blocks of texts and queries."""
    words = docs.select("doc_id", text.tokens("text").alias("pt"))
    asked = table(spark, d, "benchmark").select("item_id", text.tokens("text").alias("qt"))
    return overlap_topk(words, asked, 3)


@query(
    """
SELECT p_partkey, round(((p_brand = 'Brand#2')::INT + (contains(p_name, 'ring'))::INT + CASE WHEN p_size > 25 THEN (p_type = 'PROMO')::INT ELSE 0 END)::DOUBLE / (2 + (p_size > 25)::INT), 6) AS score,
  round(0.6 * 0.5 + 0.25 * (contains(p_name, 'ring'))::INT + 0.15 * ((p_brand = 'Brand#2')::INT + (contains(p_name, 'ring'))::INT + CASE WHEN p_size > 25 THEN (p_type = 'PROMO')::INT ELSE 0 END)::DOUBLE / (2 + (p_size > 25)::INT), 6) AS combined
FROM part
"""
)
def attribute_score(spark: SparkSession, d: str) -> DataFrame:
    null = F.lit(None).cast("string")
    product = {"category": null, "brand": F.col("p_brand"), "color": null, "secondary_colors": F.lit(None).cast("array<string>"), "subcategory": null, "style": null, "title": F.col("p_name"), "material": F.when(F.col("p_size") > 25, F.col("p_type")), "pattern": null}
    asked = {"category": null, "brand": F.lit("brand 2"), "color": null, "type": F.lit("Ring"), "material": F.lit("promo"), "pattern": null}
    score = matching.attribute_score(matching.attribute_checks(product, asked))
    overlap = text.text_overlap(F.lit("ring"), "p_name")
    combined = matching.combine_scores(F.lit(0.5), overlap, score, F.lit(True), F.lit(True))
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"), F.round(combined, 6).alias("combined"))


@query(
    """
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS pos, l_returnflag AS f, l_linestatus AS s, l_discount AS d FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN f = 'A' AND pos = 1 THEN 100 ELSE 0 END AS exact, CASE WHEN f = 'A' AND pos = 1 OR s = 'F' THEN 0 WHEN pos <= 3 THEN 45 WHEN pos <= 10 THEN 25 ELSE 10 END AS lens,
  CASE WHEN d > 0.05 THEN 50 ELSE 0 END AS brand, CASE WHEN d > 0.05 OR f = 'N' THEN 30 ELSE -20 END AS store, CASE WHEN f <> 'R' THEN 8 ELSE 0 END AS price FROM c),
t AS (SELECT *, exact + lens + brand + store + price AS score FROM b)
SELECT l_orderkey, l_linenumber, score::INTEGER AS score, round(greatest(0, least(1, score / 150)), 6) AS confidence,
  CASE WHEN greatest(0, least(1, score / 150)) < 0.3 THEN NULL WHEN exact > 0 AND score / 150 >= 0.9 THEN 'exact' WHEN exact > 0 OR score / 150 >= 0.7 AND brand > 0 THEN 'near_exact' ELSE 'similar' END AS match_type
FROM t
"""
)
def candidate_score(spark: SparkSession, d: str) -> DataFrame:
    """Additive score, confidence and type of outside candidates."""
    none, words = F.lit(None).cast("string"), F.array().cast("array<string>")
    brand = F.when(F.col("l_discount") > 0.05, "acme")
    c = {
        "exact_image": (F.col("l_returnflag") == "A") & (F.col("l_quantity") == 1), "query_used": F.when(F.col("l_linestatus") == "F", "q"), "position": F.col("l_quantity").cast("int"), "title": F.lit("An ACME thing"), "brand": none, "store": none,
        "domain": F.when(brand.isNotNull(), "shop.acme.com").when(F.col("l_returnflag") == "N", "www.zara.com").otherwise("blog.example.org"), "price": F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")), "item_brand": brand, "visible_text": none, "colors": words, "categories": words, "styles": words,
    }
    b = ranking.score_breakdown(c)
    score = sum(b.values(), F.lit(0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.cast("int").alias("score"), F.round(ranking.match_confidence(score), 6).alias("confidence"), ranking.classify_match(score, b).alias("match_type"))


@query(
    """
WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS sim, (l_tax * 100)::INT % 3 AS bad, l_returnflag AS f FROM lineitem),
t AS (SELECT *, 0.45 * sim + 0.2 * 0.75 + 0.15 * (CASE WHEN f = 'A' THEN 0.4 ELSE 0 END) + 0.1 * 0.6 + 0.05 * 0.8 + 0.05 * CASE WHEN f = 'N' THEN 1 ELSE 0.2 END AS raw FROM c)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, CASE WHEN bad > 0 THEN least(raw, 0.5 - 0.1 * bad) ELSE raw END)), 6) AS confidence FROM t
"""
)
def verified_confidence(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0)
    b = dict.fromkeys(ranking.POINTS, zero) | {"lens_top_position": F.lit(45), "same_color": F.when(F.col("l_returnflag") == "A", 15).otherwise(0), "same_brand": F.lit(50), "trusted_store": F.when(F.col("l_returnflag") == "N", 30).otherwise(0), "unknown_store": F.when(F.col("l_returnflag") != "N", -20).otherwise(0)}
    s = ranking.component_scores(b, F.lit(None).cast("string"), F.lit(1.0), F.lit(None).cast("string"), F.lit(True))
    value = ranking.verified_confidence(s, F.col("l_discount") * 10, F.round(F.col("l_tax") * 100).cast("int") % 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 6).alias("confidence"))


@query()
def either_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each search's candidates without those whose link, or domain with title, an earlier kept one has."""
    rows = view(spark, d, "candidates").withColumn("place", F.col("pos") * 1_000_000 + F.col("product_id"))
    return ranking.drop_repeats(rows.select("query_id", "place", "link", "domain", "title"), "query_id", "place")


@query(
    """
WITH r AS (SELECT l_suppkey AS fingerprint, l_orderkey * 8 + l_linenumber AS seq, l_discount AS confidence, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS color, l_linestatus AS status, l_orderkey % 10 <> 0 AS old FROM lineitem)
SELECT fingerprint, max(confidence) AS confidence, count(*) AS seen_count, NOT bool_or(old) AS created, max_by(color, seq) FILTER (WHERE color IS NOT NULL) AS color, min_by(status, seq) AS status FROM r GROUP BY fingerprint
"""
)
def fingerprint_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fingerprint"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_discount").alias("confidence"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("color"), F.col("l_linestatus").alias("status"), F.lit(1).alias("seen_count"), (F.col("l_orderkey") % 10).alias("k"))
    # sightings of one order line may repeat: the larger status would be arbitrary, so the oldest sequence number decides
    merged = upserts.fingerprint_upsert(rows.where("k <> 0").drop("k"), rows.where("k = 0").drop("k"), latest=("color",), keep=("status",))
    return merged.select("fingerprint", "confidence", "seen_count", "created", "color", "status")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def upsert_replace_latest(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return upserts.latest_rows(orders.where("o_orderkey % 7 <> 0"), orders.where("o_orderkey % 7 = 0"), ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("SELECT CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey::VARCHAR END AS connector, l_returnflag AS kind, count(*)::BIGINT AS calls, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1, 2")
def additive_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey").cast("string")).alias("connector"), F.col("l_returnflag").alias("kind"), F.lit(1).cast("long").alias("calls"), F.col("l_extendedprice").alias("cost"), "l_linenumber")
    added = upserts.additive_upsert(rows.where("l_linenumber <= 3"), rows.where("l_linenumber > 3"), ["connector", "kind"], ["calls", "cost"])
    return added.withColumn("cost", F.round("cost", 2))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return upserts.insert_or_ignore(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN -1.0::DOUBLE END AS balance FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def coalesce_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    base = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit(-1.0).alias("balance"))
    delta = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return upserts.coalesce_upsert(base, delta, ["c_custkey"])


@query("SELECT l_partkey, l_suppkey, max(l_discount) AS score FROM lineitem GROUP BY ALL")
def greatest_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_discount").alias("score"), "l_returnflag")
    return upserts.greatest_upsert(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag <> 'A'"), ["l_partkey", "l_suppkey"], "score")


@query("SELECT p_partkey, p_brand, sha256(lower(p_brand) || chr(31) || '' || chr(31) || p_name) AS key FROM part")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_brand", sha256_key(F.lower("p_brand"), F.lit(None).cast("string"), "p_name").alias("key"))


@query(
    """
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), a AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS brand FROM part WHERE p_size > 30 UNION SELECT DISTINCT p_name FROM part WHERE p_size > 48)
SELECT p_partkey, max_by(brand, len(string_split(brand, ' '))) AS brand FROM t JOIN a ON brand = w[1] OR brand = w[1] || ' ' || w[2] GROUP BY p_partkey
"""
)
def brand_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The longest allowed brand that starts each title, by an equi-join on prefixes of words."""
    part = table(spark, d, "part")
    words = F.split("p_name", " ")
    allowed = part.where("p_size > 30").select(words[0].alias("brand")).union(part.where("p_size > 48").select("p_name")).distinct()
    prefixes = part.select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(words))), lambda n: F.struct(n.alias("n"), F.concat_ws(" ", F.slice(words, 1, n)).alias("brand")))).alias("x"))
    return prefixes.join(allowed, F.col("x.brand") == allowed["brand"]).groupBy("p_partkey").agg(F.max_by("brand", "x.n").alias("brand"))


@query(
    """
WITH u AS (SELECT p_partkey, p_name, p_retailprice AS score, 'catalogue' AS origin, regexp_replace(p_name, ' .*', '') AS host FROM part WHERE p_size <= 25
  UNION ALL SELECT p_partkey, p_name, p_retailprice + 1, 'external', regexp_replace(p_name, ' .*', '') FROM part WHERE p_size > 20)
SELECT p_name, p_partkey, origin, score FROM u QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY score DESC, origin, p_partkey) = 1
"""
)
def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    cat = part.where("p_size <= 25").select("p_name", "p_partkey", F.lit("catalogue").alias("origin"), F.col("p_retailprice").alias("score"))
    ext = part.where("p_size > 20").select("p_name", "p_partkey", F.lit("external").alias("origin"), (F.col("p_retailprice") + 1).alias("score"))
    order = Window.partitionBy("p_name").orderBy(F.desc("score"), "origin", "p_partkey")
    return cat.unionByName(ext).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


@query(
    """
WITH l AS (SELECT l_orderkey, 'price' AS field, l_extendedprice::VARCHAR AS value, l_linenumber AS priority FROM lineitem WHERE l_tax > 0.02 UNION ALL SELECT l_orderkey, 'flag', l_returnflag, l_linenumber FROM lineitem WHERE l_discount > 0.02),
w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, field ORDER BY priority, value) = 1)
SELECT l_orderkey, max(CASE WHEN field = 'flag' THEN value END) AS flag, coalesce(max(CASE WHEN field = 'price' THEN priority END), -1)::INTEGER AS price_layer, count(*) AS fields FROM w GROUP BY l_orderkey
"""
)
def layer_merge(spark: SparkSession, d: str) -> DataFrame:
    """Per page and field the value of the strongest layer, side by side again."""
    from vcspark.operators.extraction import strongest_layers

    li = table(spark, d, "lineitem")
    layers = li.where("l_tax > 0.02").select("l_orderkey", F.lit("price").alias("field"), F.col("l_extendedprice").cast("string").alias("value"), F.col("l_linenumber").alias("priority"))
    layers = layers.unionByName(li.where("l_discount > 0.02").select("l_orderkey", F.lit("flag").alias("field"), F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("priority")))
    best = strongest_layers(layers, ["l_orderkey"], "field", "value", "priority")
    at = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return best.groupBy("l_orderkey").agg(at("flag", "value").alias("flag"), F.coalesce(at("price", "priority"), F.lit(-1)).alias("price_layer"), F.count("*").alias("fields"))


@query()
def hash_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", hash_embedding(text.norm_strict("p_name")).alias("vector"))


@query()
def html_layers(spark: SparkSession, d: str) -> DataFrame:
    from vcspark.operators.extraction import page_layers

    return page_layers(table(spark, d, "pages"))


@query("""
WITH v AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
s AS (SELECT x.vec_id AS left_id, y.vec_id AS right_id, list_sum(list_transform(list_zip(x.e, y.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (x.n * y.n) AS c FROM v x JOIN v y ON x.vec_id < y.vec_id)
SELECT left_id, right_id, round(c, 4) AS cosine FROM s WHERE c >= 0.7
""")
def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors whose cosine is at least 0.7."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return dedup.near_vector_pairs(v, v, 0.7).where("left_id < right_id").select("left_id", "right_id", F.round("similarity", 4).alias("cosine"))


@query("SELECT doc_id, bit_count(xor(('0x' || substr(md5(text), 1, 8))::BIGINT, ('0x' || substr(sha256(text), 1, 8))::BIGINT))::INTEGER + bit_count(xor(('0x' || substr(md5(text), 9, 8))::BIGINT, ('0x' || substr(sha256(text), 9, 8))::BIGINT))::INTEGER AS distance FROM documents")
def hamming_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hamming(F.substring(F.md5("text"), 1, 16), F.substring(F.sha2("text", 256), 1, 16)).alias("distance"))
