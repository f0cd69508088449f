"""Views of the tables as detected items, outside candidates, jobs and connectors, for both engines.

Each is one SELECT that Spark and DuckDB read alike: Spark with DataFrames in the
braces, DuckDB as a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vcspark.plans.registry import table

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "items": (
        ("lineitem", "part"),
        """
SELECT l_orderkey AS job_id, l_linenumber AS item_no, l_partkey AS product_id, l_suppkey AS frame_id, p_brand AS brand,
  replace(replace(replace(replace(p_name, 'widget', 'Reloj'), 'bolt', 'sneaker'), 'rod', 'Planta'), 'anvil', 'puerta') AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'Ropa' WHEN 'PROMO' THEN 'Decoración' WHEN 'STANDARD' THEN 'electronics' WHEN 'LARGE' THEN 'wall' WHEN 'SMALL' THEN 'accesorio' ELSE 'otros' END AS category,
  CASE WHEN p_size % 4 = 0 THEN 'bolso' END AS subcategory,
  CASE l_returnflag WHEN 'A' THEN CASE l_linestatus WHEN 'F' THEN 'worn' ELSE 'held' END WHEN 'N' THEN 'near_person' ELSE CASE WHEN l_tax < 0.04 THEN 'background' END END AS relationship,
  l_discount * 10 AS confidence, CASE WHEN l_linenumber < 5 THEN l_quantity / 50 END AS relevance,
  CASE WHEN l_tax >= 0.06 THEN 'striped' WHEN l_tax >= 0.03 THEN 'Plain' END AS pattern, l_quantity >= 45 AS logo_visible,
  CASE WHEN p_size >= 40 THEN p_brand END AS visible_brand, CASE WHEN l_suppkey % 7 = 0 THEN p_name END AS visible_text,
  l_extendedprice / 100000 AS area, CASE WHEN l_partkey % 3 = 0 THEN l_tax * 20 END AS person_score, l_shipdate AS seen_at
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    ),
    "candidates": (
        ("lineitem", "supplier"),
        """
SELECT l_orderkey AS query_id, l_linenumber AS pos, l_partkey AS product_id,
  CASE l_suppkey % 6 WHEN 0 THEN 'www.pinterest.es' WHEN 1 THEN 'shop.example.com' WHEN 2 THEN 'blog.wordpress.com' WHEN 3 THEN 'zara.com' WHEN 4 THEN 'news.example.org' END AS domain,
  CASE WHEN l_linenumber = 7 THEN 'ftp://' ELSE 'https://' END || CASE l_suppkey % 6 WHEN 5 THEN 'store.example.net' ELSE 'shop.example.com' END || '/p/' || l_partkey AS link,
  CASE l_partkey % 9 WHEN 0 THEN 'An interview about item ' WHEN 1 THEN 'Biografía ' ELSE 'Item ' END || l_partkey AS title,
  CASE WHEN l_discount > 0.04 THEN l_extendedprice END AS price, CASE WHEN l_discount > 0.07 THEN 'USD' END AS currency, CASE WHEN l_suppkey % 4 = 0 THEN s_name END AS store,
  CASE WHEN l_tax > 0.05 THEN 'Brand ' || (l_suppkey % 5) END AS brand, CASE WHEN l_tax > 0.01 THEN 'https://img.example.com/' || l_partkey END AS image_url,
  CASE l_returnflag WHEN 'A' THEN 'products' WHEN 'N' THEN 'visual' ELSE 'shopping' END AS source_type, l_linestatus = 'F' AS exact, l_quantity * 4 - 20 AS score,
  CASE l_suppkey % 3 WHEN 0 THEN 'serpapi_google_lens' WHEN 1 THEN 'other_provider' ELSE 'dataforseo_google_shopping' END AS provider,
  CASE WHEN l_quantity > 30 THEN 'exact' WHEN l_quantity > 20 THEN 'similar' END AS match_type, CASE l_returnflag WHEN 'A' THEN 'catalog' ELSE 'external' END AS source
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey""",
    ),
    "jobs": (
        ("orders",),
        """
SELECT o_orderkey AS job_id, o_custkey AS owner_id, o_orderkey % 97 AS media_id, o_orderdate AS created_at, o_totalprice / 1000 AS cost,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status, substring(o_orderpriority, 3) AS kind
FROM {orders}""",
    ),
    "connectors": (
        ("supplier",),
        """
SELECT s_suppkey AS connector_id, s_suppkey % 11 = 0 AS paused, s_suppkey % 13 <> 0 AS enabled, s_suppkey % 7 = 0 AS agreement, s_suppkey % 5 <> 0 AS credentials, s_acctbal > 5000 AS live,
  CASE s_nationkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' WHEN 2 THEN 'beta' ELSE 'partner_required' END AS lifecycle,
  CASE s_suppkey % 6 WHEN 0 THEN 'disallowed' WHEN 1 THEN 'blocked' WHEN 2 THEN 'error' ELSE 'ok' END AS health, CASE s_nationkey % 5 WHEN 0 THEN 'scaffold' ELSE 'bespoke' END AS implementation
FROM {supplier}""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needs, select = VIEWS[name]
    return spark.sql(select, **{n: table(spark, sf_dir, n) for n in needs})


def sql(body: str, *names: str) -> str:
    """``body`` for DuckDB after the views that it reads."""
    views = [f"{n} AS ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names]
    return f"WITH {', '.join(views)}{',' if body.lstrip().startswith('+') else ''} {body.lstrip().lstrip('+')}"
