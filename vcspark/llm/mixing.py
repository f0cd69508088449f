"""Mixing sources to target weights by pivotal dependent rounding.

Each document is to be taken target / source size times on average: the whole part for
certain, the fraction by chance. Fractions are rounded in pairs: mass moves at random
from one document to the other, weighted by their sizes, until one of the two is taken
or not for certain; the other goes on to the next pair. Expectations and the source's
total stay as they are, so a source misses its target by less than the last document
left over. Pairs are made within blocks of bounded size, large documents first; what
blocks leave over goes up a reduction tree. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vcspark.sources.shared import save_shared

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 256
BROADCAST_SOURCES = 100_000
_SIZE = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    """Number of runs of anything but space and U+0009..U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_SIZE)), F.lit(0)).cast("long")


def row_hash(id_col: str, text_col: str, seed: int = 1) -> Column:
    """What a row's chances derive from."""
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n, target) from (doc_id, source, size).

    Sources by code point, null last, weigh ``weights``, repeating, and share all
    sizes by weight. A target stops at ``cap`` times its source's size and the excess
    is shared again by weight until none is above; that is the level at which
    min(cap * size, weight * level) adds up to the total. Works on the table of
    sources, one short row each, which one task sorts: their number may reach tens of
    millions, so sources may be hosts, but not addresses.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = stats.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(place, F.lit(len(weights)))].cast("double"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = weighed.withColumn("total", F.sum("source_size").over(everything)).withColumn("capped", (F.sum("source_size").over(by_level) - F.col("source_size")) * cap).withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
    level = (F.col("total") - F.col("capped")) / F.col("open")
    levelled = summed.withColumn("level", F.max(F.when(F.col("source_size") * cap / F.col("weight") >= level, level)).over(everything))
    target = F.least(F.col("source_size") * float(cap), F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return levelled.select("source", "source_size", "n", target.alias("target"))


def _fold(seed: int) -> Column:
    """From ``items``, an array of (size, h, doc_id, p): the settled documents and the one left over.

    The left-over has p strictly between 0 and 1; none is a null struct.
    """
    item = "struct<size:bigint,h:bigint,doc_id:bigint,p:double>"
    # a is the document left over so far, b the next one; up: a gains, b loses
    return F.expr(
        f"""aggregate(items,
          named_struct('left', cast(null as {item}), 'done', cast(array() as array<struct<doc_id:bigint,h:bigint,size:bigint,extra:int>>)),
          (s, b) -> if(s.left is null, named_struct('left', b, 'done', s.done),
            transform(array(named_struct(
              'a', s.left, 'b', b,
              'up', least((1D - s.left.p) * s.left.size, b.p * b.size),
              'down', least(s.left.p * s.left.size, (1D - b.p) * b.size),
              'u', (xxhash64(s.left.h, b.h, {seed}L) & 9007199254740991L) / 9007199254740992D)),
            m -> transform(array(if(m.u * (m.up + m.down) < m.down,
                named_struct('pa', if((1D - m.a.p) * m.a.size <= m.b.p * m.b.size, 1D, m.a.p + m.up / m.a.size),
                             'pb', if((1D - m.a.p) * m.a.size >= m.b.p * m.b.size, 0D, m.b.p - m.up / m.b.size)),
                named_struct('pa', if(m.a.p * m.a.size <= (1D - m.b.p) * m.b.size, 0D, m.a.p - m.down / m.a.size),
                             'pb', if(m.a.p * m.a.size >= (1D - m.b.p) * m.b.size, 1D, m.b.p + m.down / m.b.size)))),
              r -> named_struct(
                'left', case when r.pa > 0D and r.pa < 1D then named_struct('size', m.a.size, 'h', m.a.h, 'doc_id', m.a.doc_id, 'p', r.pa)
                             when r.pb > 0D and r.pb < 1D then named_struct('size', m.b.size, 'h', m.b.h, 'doc_id', m.b.doc_id, 'p', r.pb) end,
                'done', concat(s.done,
                  if(r.pa > 0D and r.pa < 1D, array(), array(named_struct('doc_id', m.a.doc_id, 'h', m.a.h, 'size', m.a.size, 'extra', cast(r.pa >= 1D as int)))),
                  if(r.pb > 0D and r.pb < 1D, array(), array(named_struct('doc_id', m.b.doc_id, 'h', m.b.h, 'size', m.b.size, 'extra', cast(r.pb >= 1D as int)))))))[0])[0]))"""
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, row_hash), one row for each row of ``docs``.

    ``copies`` is how often the mix takes the document, ``taken`` = copies * size; no
    document is taken more than ``cap`` times. Sums of ``taken`` by source come within
    half of the last document left over, which is rounded to the nearer side, of
    ``target``. All chance is a hash of the row and
    ``seed``, so reruns agree. Null and wordless texts have size 0: they are taken the
    whole part of target / source size times. Rows that repeat an id are rounded each
    for itself; ``row_hash``, a hash of id and text, tells their texts apart. A null
    source is a source. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), row_hash(id_col, text_col, seed).alias("h"))
    rows = save_shared(rows, "mix-sizes")
    sources = save_shared(source_targets(rows, weights, cap), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    most = sources.agg(F.max("n").alias("n")).first().n or 0
    named = sources.withColumnRenamed("source", "s")
    joined = rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= F.col("source_size") * float(cap), float(cap)).otherwise(F.col("target") / F.col("source_size"))
    rated = joined.withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
    about = ["source", "source_size", "target", "whole"]
    certain = rated.where("size = 0 or p = 0").select("doc_id", "h", "size", *about, F.lit(0).alias("extra"))
    block = F.pmod(F.xxhash64("h", "doc_id"), F.ceil(F.col("n") / BLOCK))
    level = rated.where("size > 0 and p > 0").select(*about, block.alias("block"), F.struct("size", "h", "doc_id", "p").alias("item"))
    settled, blocks, depth = [certain], -(-most // BLOCK), 0
    while True:
        items = level.groupBy(*about, "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = save_shared(items.select(*about, "block", _fold(seed + depth).alias("f")), "mix-level")
        settled.append(folded.select(*about, F.inline("f.done")).select("doc_id", "h", "size", *about, "extra"))
        left = folded.where("f.left is not null").select(*about, F.col("block"), F.col("f.left").alias("item"))
        if blocks <= 1:
            settled.append(left.select("item.doc_id", "item.h", "item.size", *about, (F.col("item.p") >= 0.5).cast("int").alias("extra")))
            break
        level, blocks, depth = left.withColumn("block", F.floor(F.col("block") / BLOCK)), -(-blocks // BLOCK), depth + 1
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.col("extra")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"), F.col("h").alias("row_hash"))
