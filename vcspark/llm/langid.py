"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from byte trigrams; to them are added the declared markup
language, the address suffix and a host prior, whose tables are grouped aggregations
over all rows. The host prior is smoothed hierarchically: host, registered domain, all.
A text's evidence is bounded, so that a weak text yields to them. One more class, ``und``, has all trigrams equally likely: what fits no language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vcspark.llm.blocks import blocks_of, declared_language
from vcspark.llm.textops import batches
from vcspark.llm.url_filter import host_of
from vcspark.operators.skew import salted_join
from vcspark.sources.shared import save_shared

UND = "und"
BUCKETS = 1 << 16
TRAINING_ROWS = 4000
LEAST_ROWS = 5
#: Training rows of each language where an equal share of ``max_rows`` would be less.
LABEL_ROWS = 100
SMOOTHING = 10.0
#: Trigrams overlap, so each counts for a part of one, and a text counts for at most so many
#: independent ones, however long: what a page quotes or repeats isn't new evidence.
TRIGRAM_WEIGHT = 1 / 3
MOST_TRIGRAMS = 24.0
_ADDED = 0.05

_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


class Model(NamedTuple):
    """``logs`` has a row for each bucket and a column for each language, ``und`` last."""

    languages: list[str]
    logs: np.ndarray


def _trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of letters and word ends."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    grams = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    grams = grams[(raw[1:-1] != 32)]
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(16)


def visible_text(page: str) -> str:
    return "\n".join(b.text for b in blocks_of(page))


def train(rows: DataFrame, key: str, label: str, raw: str, max_rows: int = TRAINING_ROWS, parse: Callable[[str], str] = str) -> Model:
    """A model of every label that ``LEAST_ROWS`` rows or more have; ``parse`` makes the text from column ``raw``.

    Labels are primary subtags, counted over all rows, so which languages exist doesn't
    depend on a sample. Each trains on its rows with the smallest hashes: on equal
    shares of ``max_rows``, but on ``LABEL_ROWS`` each where languages are so many that
    their share would be less. About twice as many rows as wanted pass a threshold on
    the hash, which comes from the label's own count, before a text is parsed; if keys
    repeat so that too few do, it is raised.
    """
    stated = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(raw).alias("raw")).where("label is not null and raw is not null")
    labels = save_shared(stated.groupBy("label").agg(F.count("*").alias("rows_n")).where(F.col("rows_n") >= LEAST_ROWS), "lang-labels")
    wanted = max(LABEL_ROWS, max_rows // max(1, labels.count()))
    order, part = Window.partitionBy("label").orderBy(F.xxhash64("label", "raw")), 2.0
    while True:
        bounds = labels.select("label", "rows_n", (F.least(F.lit(1.0), F.lit(part * wanted) / F.col("rows_n")) * 2.0**40).cast("long").alias("bound"))
        near = stated.join(F.broadcast(bounds), "label").where(F.pmod(F.xxhash64("key"), F.lit(2**40)) < F.col("bound"))
        sample = save_shared(near.select("label", "raw").withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted), "lang-sample")
        sampled = sample.groupBy("label").agg(F.count("*").alias("n"))
        short = bounds.join(sampled, "label", "left").where((F.col("bound") < 2**40) & (F.coalesce("n", F.lit(0)) < F.least("rows_n", F.lit(wanted))))
        if short.isEmpty():
            break
        part *= 8

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.full(BUCKETS, _ADDED)
        for raw in group.raw:
            counts += np.bincount(_trigrams(parse(raw)), minlength=BUCKETS)
        return pd.DataFrame({"label": [group.label.iloc[0]], "logs": [np.log(counts / counts.sum()).astype(np.float32)]})

    found = sample.groupBy("label").applyInPandas(learn, "label string, logs array<float>").toPandas().sort_values("label")
    logs = np.full((BUCKETS, len(found) + 1), -np.log(BUCKETS), np.float32)
    for i, column in enumerate(found.logs):
        logs[:, i] = column
    return Model(found.label.tolist(), logs)


def text_evidence(rows: DataFrame, model: Model, keep: list[str], text: str, from_html: bool = False) -> DataFrame:
    """``keep``, then grams (number of trigrams), scores (tempered log likelihood by language, ``und`` last), text_lang (the best; null without letters) and, from html, declared."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = [rows.schema[c] for c in keep]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = shared.value
        names = [*languages, UND]
        for part in parts:
            for batch in batches(part, "__text"):
                n, scores, best, declared = [], [], [], []
                for t in batch.column("__text").to_pylist():
                    t = t or ""
                    if from_html:
                        declared.append(declared_language(t))
                        t = visible_text(t)
                    grams = _trigrams(t)
                    s = logs[grams].sum(axis=0, dtype=np.float64) * min(TRIGRAM_WEIGHT, MOST_TRIGRAMS / len(grams)) if len(grams) else np.zeros(len(names))
                    n.append(len(grams))
                    scores.append(s)
                    best.append(names[int(s.argmax())] if len(grams) else None)
                values = np.concatenate(scores) if scores else np.zeros(0)
                offsets = np.arange(len(scores) + 1, dtype=np.int32) * len(names)
                columns = [*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(best, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(declared, pa.string())] if from_html else []), names=[*keep, "grams", "scores", "text_lang", *(["declared"] if from_html else [])])

    schema = T.StructType([*fields, T.StructField("grams", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("text_lang", T.StringType())])
    if from_html:
        schema.add("declared", T.StringType())
    return rows.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def exact_name(column: str) -> Column:
    """The column of just this name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def _counts(rows: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """(key, rows_n, votes): rows of each key, and how many of them the text puts in each class."""
    votes = F.array(*[F.sum((F.col("text_lang") == c).cast("long") * F.col("n")) for c in classes])
    return rows.groupBy(key).agg(F.sum("n").alias("rows_n"), votes.alias("votes"))


def _add(a: Column | str, f) -> Column:
    return F.transform(a, f)


def _smoothed(votes: Column, parent: Column) -> Column:
    total = F.aggregate(votes, F.lit(0).cast("long"), lambda s, v: s + v)
    return F.transform(votes, lambda v, i: (v + parent[i] * SMOOTHING) / (total + SMOOTHING))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` (a saved table with scores, text_lang, grams, declared, host, suffix) with lang and prob.

    Tables of votes by host, domain, suffix and declared language cover all rows.
    A null or unknown declared language, an empty suffix and an empty host say nothing.
    Equal probabilities: the smaller language name, ``und`` last. A text without
    letters is ``und`` with probability 1. If no language has been learned, any other
    text has a null ``lang``: nothing speaks for or against it. A text that fits none
    and declares a language with too few rows to be learned has that language.
    """
    classes = [*languages, UND]
    known = F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared").isNotNull(), "other")
    rows = rows.withColumn("declared_class", known)
    voted = save_shared(rows.where("text_lang is not null").groupBy("host", "suffix", "declared_class", "text_lang").agg(F.count("*").alias("n")).withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)), "lang-votes")
    overall = voted.withColumn("one", F.lit(1))
    top = _counts(overall, "one", classes).select(_smoothed(F.col("votes"), F.array_repeat(F.lit(1.0 / len(classes)), len(classes))).alias("top"))
    first = top.first()
    overall_prior = F.array(*map(F.lit, first.top if first else [1.0 / len(classes)] * len(classes)))
    domains = _counts(voted, "domain", classes).select("domain", _smoothed(F.col("votes"), overall_prior).alias("above"))
    hosts = voted.groupBy("host", "domain").agg(F.sum("n").alias("n"), F.array(*[F.sum((F.col("text_lang") == c).cast("long") * F.col("n")) for c in classes]).alias("votes"))
    weights = hosts.groupBy("domain").agg(F.count("*").alias("w"))
    hosts = save_shared(hosts, "lang-hosts")
    hosts = salted_join(hosts, save_shared(domains.join(weights, "domain"), "lang-domains"), ["domain"], "w", "host", "inner")
    all_rows = rows.groupBy("host").agg(F.count("*").alias("rows_n"))
    priors = save_shared(all_rows.join(hosts.select("host", _smoothed(F.col("votes"), F.col("above")).alias("prior")), "host", "left"), "lang-priors")

    def likelihood(key: str, name: str) -> DataFrame:
        """How likely the key's value is under each class, relative to its share of all rows."""
        share = F.transform(F.col("votes"), lambda v, i: (v + overall_prior[i] * SMOOTHING) / (F.aggregate("votes", F.lit(0).cast("long"), lambda s, x: s + x) + SMOOTHING) / overall_prior[i])
        return save_shared(_counts(voted.where(F.col(key).isNotNull() & (F.col(key) != "")), key, classes).select(key, share.alias(name), "rows_n"), f"lang-{key}")

    out = salted_join(rows, priors, ["host"], "rows_n", "__spread").drop("rows_n")
    out = salted_join(out, likelihood("suffix", "by_suffix"), ["suffix"], "rows_n", "__spread").drop("rows_n")
    stated = likelihood("declared_class", "by_declared").drop("rows_n")  # a row for each language of the model and "other"
    out = out.join(F.broadcast(stated), "declared_class", "left")
    none = F.array_repeat(F.lit(1.0), len(classes))
    evidence = F.transform("scores", lambda s, i: s + F.log(F.coalesce("prior", overall_prior)[i]) + F.log(F.coalesce("by_suffix", none)[i]) + F.log(F.coalesce("by_declared", none)[i]))
    out = out.withColumn("__e", evidence).withColumn("__max", F.array_max("__e"))
    place = (F.array_position(F.col("__e"), F.col("__max")) - 1).cast("int")
    total = F.aggregate("__e", F.lit(0.0), lambda a, e: a + F.exp(e - F.col("__max")))
    best = F.array(*map(F.lit, classes))[place] if languages else F.lit(None).cast("string")
    lang = F.when(F.col("grams") == 0, UND).when((best == UND) & (F.col("declared_class") == "other"), F.col("declared")).otherwise(best)
    return out.withColumn("lang", lang).withColumn("prob", F.when(F.col("grams") == 0, 1.0).otherwise(F.round(1 / total, 6))).drop("__e", "__max", "declared_class", "prior", "by_suffix", "by_declared")


def identify_pages(pages: DataFrame, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """(page_id, host, suffix, declared, text_lang, grams, lang, prob), one row for each row of ``pages`` (page_id, url, html).

    The model is trained on a bounded sample of pages of each declared language; the
    evidence tables cover all pages. Null html has no letters (``und``), a null url an
    empty host. Whole pages are read; other columns are not.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    stated = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,8})", 1))
    model = train(source.select("page_id", F.when(stated != "", stated).alias("label"), "html"), "page_id", "label", "html", max_rows, visible_text)
    host = host_of("url")
    addressed = source.select("page_id", host.alias("host"), F.regexp_extract(host, r"\.([a-z]+)(?::\d+)?$", 1).alias("suffix"), "html", F.xxhash64("page_id", "url").alias("__spread"))
    seen = save_shared(text_evidence(addressed, model, ["page_id", "host", "suffix", "__spread"], "html", from_html=True), "lang-pages")
    return fuse(seen, model.languages).select("page_id", "host", "suffix", "declared", "text_lang", "grams", "lang", "prob")


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_rows: int = TRAINING_ROWS) -> DataFrame:
    """(input's columns, detected_lang, detected_prob), one row for each row of ``docs``.

    ``lang_col`` is the declared language and trains the model (a bounded sample of each),
    ``source_col`` is the host; there is no address suffix. Text without letters, null
    and empty text are ``und``. Added columns replace any of the same name.
    """
    carried = [c for c in docs.columns if c not in ("detected_lang", "detected_prob")]
    stated = F.lower(F.regexp_extract(F.col(lang_col).cast("string"), r"^\s*([a-zA-Z]{2,8})", 1))
    stated = F.when(stated != "", stated)
    model = train(docs.select(F.col(id_col).alias("key"), stated.alias("label"), F.col(text_col).cast("string").alias("text")), "key", "label", "text", max_rows)
    rows = docs.select(F.struct(*map(exact_name, carried)).alias("__row"), F.col(text_col).alias("__t"), stated.alias("declared"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("host"), F.lit("").alias("suffix"), F.xxhash64(id_col).alias("__spread"))
    seen = save_shared(text_evidence(rows, model, ["__row", "declared", "host", "suffix", "__spread"], "__t"), "lang-documents")
    fused = fuse(seen, model.languages)
    return fused.select("__row.*", F.col("lang").alias("detected_lang"), F.col("prob").alias("detected_prob"))
