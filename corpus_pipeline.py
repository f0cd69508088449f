"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vcspark.llm.exact_dedup import exact_dedup, normalised
from vcspark.llm.langid import UND, exact_name, identify_documents
from vcspark.llm.mixing import mix_sources, row_hash
from vcspark.llm.near_dedup import near_duplicates
from vcspark.llm.packing import pack_documents
from vcspark.sources.shared import save_shared

#: Rows (id and digest, under 100 bytes each) that are broadcast rather than shuffled.
BROADCAST_ROWS = 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose evidence fits one of the corpus's languages better than none (null and letterless texts go; where no language has been learned, all others stay)."""
    return identify_documents(docs).where(~F.col("detected_lang").eqNullSafe(UND)).select(*map(exact_name, docs.columns))


def _without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` without the rows whose keys are in ``dropped`` (saved; null keys match null keys)."""
    gone = dropped.select(*[F.col(k).alias(f"__{k}") for k in keys])
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = F.lit(True)
    for k in keys:
        same = same & docs[k].eqNullSafe(gone[f"__{k}"])
    return docs.join(gone, same, "left_anti")


def _marked(docs: DataFrame, **marks: Column) -> DataFrame:
    """``docs`` with columns ``_0``, ``_1``, ... and the marks, so that no name clashes."""
    return docs.select(*[exact_name(c).alias(f"_{i}") for i, c in enumerate(docs.columns)], *[m.alias(k) for k, m in marks.items()])


def _unmarked(marked: DataFrame, columns: list[str]) -> DataFrame:
    return marked.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; of rows that share id and text, one."""
    decisions = save_shared(exact_dedup(docs), "stage-exact")
    dropped = save_shared(decisions.where("not kept").select("doc_id", "text_sha256").distinct(), "stage-exact-dropped")
    rest = _without(_marked(docs, doc_id=F.col("doc_id"), text_sha256=F.sha2(normalised("text"), 256)), dropped, ["doc_id", "text_sha256"])
    if not decisions.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        rest = rest.dropDuplicates(["doc_id", "text_sha256"])
    return _unmarked(rest, docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles join (similarity 0.8 or more), one stays: that with the smallest id.

    Id and text together name a document, so other texts of an id stay.
    """
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    decisions = near_duplicates(docs.select("doc_id", "text", key.alias("key")), width=5, percent=80, key_col="key")
    dropped = save_shared(decisions.where("not kept").select("doc_id", "key").distinct(), "stage-near-dropped")
    return _unmarked(_without(_marked(docs, doc_id=F.col("doc_id"), key=key), dropped, ["doc_id", "key"]), docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Of rows that share id, source and text, one stands for all: it comes as often as
    the mix takes them together.
    """
    keys = ["doc_id", "source", "row_hash"]
    copies = mix_sources(docs).groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    copies = save_shared(copies.where("copies > 0"), "stage-mix")
    marked = _marked(docs, doc_id=F.col("doc_id").cast("long"), source=F.col("source").cast("string"), row_hash=row_hash("doc_id", "text"))
    same = F.lit(True)
    for k in keys:
        same = same & marked[k].eqNullSafe(copies[f"m_{k}"])
    taken = marked.join(copies, same)
    if not copies.where("rows > 1").isEmpty():
        taken = taken.where("rows = 1").union(taken.where("rows > 1").dropDuplicates(keys))
    return _unmarked(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix_sources", mix_stage),
    ("pack", pack_stage),
]

#: Neither language evidence nor random rounding nor tokenizing is SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is saved and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
