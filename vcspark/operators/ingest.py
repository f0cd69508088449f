"""Ingesting a batch of listings into a catalogue, with the outcome that taking its rows one after the other has.

A row may be the listing of a product that an earlier row of the same batch made, so
outcomes depend on each other. They are settled in rounds, each a saved table: of the
rows that match nothing in the catalogue, one that is the earliest in all of its keys
becomes a product, and all later rows under one of its keys match it. No pairs of rows
are made; a round is a grouping by key and a join back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vcspark.operators.skew import salted_join
from vcspark.sources.shared import drop_shared, save_shared

#: Levels of a match, the strongest first, and the columns that make up its key. Both of the last count alike.
LADDER = [("source_product_id", 0, ["source", "source_product_id"]), ("canonical_url", 1, ["canonical_url"]), ("image_sha256", 2, ["image_sha256"]), ("sku_gtin", 3, ["sku"]), ("sku_gtin", 3, ["gtin"])]
LEVELS = ["source_product_id", "canonical_url", "image_sha256", "sku_gtin"]
#: Levels up to which a match is the same listing, seen again.
SAME_LISTING = 1
HISTORY = 200
_CHUNK = 65_536
_CODEC = "zstd"


def _keys(rows: DataFrame, name: str) -> DataFrame:
    """(name, n, kind, key): one row for each key that a row has; null and empty keys match nothing."""
    kinds = []
    for kind, (_, n, columns) in enumerate(LADDER):
        present = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != "", F.lit(False)) for c in columns])
        kinds.append(F.when(present, F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), F.to_json(F.array(*columns)).alias("key"))))
    return rows.select(F.col(name), F.explode(F.array_compact(F.array(*kinds))).alias("k")).select(name, "k.*")


def _earliest(keys: DataFrame) -> DataFrame:
    """``keys`` (seq, n, kind, key) with ``first``, the smallest seq under the same key."""
    by_key = save_shared(keys.groupBy("kind", "key").agg(F.min("seq").alias("first"), F.count("*").alias("held")), "ingest-first", _CODEC)
    return salted_join(keys, by_key, ["kind", "key"], "held", "seq", "inner")


def settle_first(keys: DataFrame) -> DataFrame:
    """(seq) of the rows that win: in order of seq, each that shares no key with an earlier winner.

    ``keys``: seq, n, kind, key, saved. Rows without any key aren't in it and win as well.
    Every round settles all rows that are first under all their keys and those beaten by
    them; the number of rounds is that of the longest chain of rows that wait for each other.
    """
    left, won = keys, []
    while True:
        seen = save_shared(_earliest(left), "ingest-round", _CODEC)
        winners = seen.groupBy("seq").agg(F.max(F.col("first") < F.col("seq")).alias("waits")).where("not waits").select("seq")
        winners = save_shared(winners, "ingest-won", _CODEC)
        won.append(winners)
        beaten = seen.where("first < seq").join(winners.select(F.col("seq").alias("first")), "first", "left_semi").select("seq")
        gone = beaten.union(winners).distinct()
        rest = save_shared(seen.select("seq", "n", "kind", "key").join(gone, "seq", "left_anti"), "ingest-left", _CODEC)
        drop_shared(seen, *([left] if left is not keys else []))
        if rest.isEmpty():
            return reduce(DataFrame.union, won)
        left = rest


def ingest(batch: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(seq, action, level, product_id, made_by, price_point): what becomes of each row of ``batch``, in order of seq.

    ``batch``: seq (long, not null, each once), source, source_product_id, canonical_url,
    image_sha256, sku, gtin, content_hash (which covers the price) and price.
    ``catalogue``: id (long) instead of seq. Actions: new, changed and unchanged (the same
    listing by id or address, its content other than last time or not) and duplicate
    (matched by picture, sku or gtin only). A match has the strongest level, then a
    product of the catalogue before one of the batch, then the smallest id. It is by the
    keys that a product was made with. ``product_id`` is that of the catalogue, ``made_by``
    the seq of the row that made the product. A price point is due for a new product with
    a price, and where a changed listing has another price than before.
    """
    mine = save_shared(_keys(batch, "seq"), "ingest-keys", _CODEC)
    theirs = _keys(catalogue, "id").groupBy("kind", "key").agg(F.min("id").alias("id"))
    counts = mine.groupBy("kind", "key").agg(F.count("*").alias("held"))
    known = save_shared(theirs.join(counts, ["kind", "key"]), "ingest-known", _CODEC)
    old = salted_join(mine, known, ["kind", "key"], "held", "seq", "inner").select("seq", F.struct("n", F.lit(0).alias("made"), F.col("id").alias("ref")).alias("m"))
    old = save_shared(old, "ingest-old", _CODEC)
    open_rows = save_shared(mine.join(old.select("seq").distinct(), "seq", "left_anti"), "ingest-open", _CODEC)
    winners = save_shared(settle_first(open_rows), "ingest-winners", _CODEC)
    by_key = save_shared(mine.join(winners, "seq", "left_semi").select("kind", "key", F.col("seq").alias("first")).join(counts, ["kind", "key"]), "ingest-made", _CODEC)
    fresh = salted_join(mine, by_key, ["kind", "key"], "held", "seq", "inner").where("first < seq").select("seq", F.struct("n", F.lit(1).alias("made"), F.col("first").alias("ref")).alias("m"))
    best = old.unionByName(fresh).groupBy("seq").agg(F.min("m").alias("m"))
    rows = batch.select("seq", _digest("content_hash"), F.col("price").cast("double").alias("price")).join(best, "seq", "left")
    product = F.coalesce("m", F.struct(F.lit(-1).alias("n"), F.lit(1).alias("made"), F.col("seq").alias("ref")))
    placed = rows.select("seq", "hash", "price", product["n"].alias("n"), product["made"].alias("made"), product["ref"].alias("ref"))
    return _outcomes(save_shared(placed, "ingest-placed", _CODEC), catalogue)


def _digest(content_hash: str) -> Column:
    """A content hash as sixteen bytes, null for null: it is only compared, and moves with every row."""
    return F.unhex(F.md5(content_hash)).alias("hash")


def _outcomes(placed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Actions by comparing each listing with the one before it of the same product.

    A product's listings are sorted after the catalogue's content, which stands before them
    as a row without seq, and compared in one pass: rows are shuffled once and joined to
    nothing. Products with ``_CHUNK`` listings or more, of which there are few, are
    compared in chunks of seq, so tasks share them; a chunk's first listing looks at the
    last of the chunk before. Duplicates are compared with nothing and stay where they are.
    """
    listing, product = F.col("n") <= SAME_LISTING, ["made", "ref"]
    base = catalogue.select(F.lit(0).alias("made"), F.col("id").alias("ref"), _digest("content_hash"), F.col("price").cast("double").alias("price"))
    many = save_shared(placed.where(listing).groupBy(*product).agg(F.count("*").alias("held")).where(F.col("held") >= _CHUNK).select(*product, F.lit(True).alias("many")), "ingest-many", _CODEC)
    rows, start = placed.withColumn("chunk", F.lit(0).cast("long")), base.withColumn("chunk", F.lit(0).cast("long"))
    if not many.isEmpty():
        rows = placed.join(F.broadcast(many), product, "left").withColumn("chunk", F.when(F.col("many") & listing, F.floor(F.col("seq") / _CHUNK)).otherwise(0)).drop("many")
        chunks = rows.where(listing).join(F.broadcast(many), product, "left_semi").groupBy(*product, "chunk").agg(F.max_by(F.struct("hash", "price"), "seq").alias("last"))
        entry = F.coalesce(F.lag("last").over(Window.partitionBy(*product).orderBy("chunk")), "base")
        entries = chunks.join(base.select(*product, F.struct("hash", "price").alias("base")), product, "left").withColumn("entry", entry).where("entry is not null")
        start = start.join(F.broadcast(many), product, "left_anti").unionByName(entries.select(*product, "chunk", "entry.*"))
    order = Window.partitionBy(*product, "chunk").orderBy(F.asc_nulls_first("seq"))
    compared = rows.where(listing).unionByName(start, allowMissingColumns=True).withColumn("prior", F.lag(F.struct("hash", "price")).over(order)).where("seq is not null")
    rows = compared.unionByName(rows.where(~listing), allowMissingColumns=True)
    same = F.col("prior.hash").eqNullSafe(F.col("hash"))
    action = F.when(F.col("n") < 0, "new").when(F.col("n") > SAME_LISTING, "duplicate").when(same, "unchanged").otherwise("changed")
    other = F.col("price").isNotNull() & ~F.col("price").eqNullSafe(F.col("prior.price"))
    level = F.get(F.array(*map(F.lit, LEVELS)), F.col("n"))
    return rows.select(
        "seq", action.alias("action"), F.when(F.col("n") >= 0, level).alias("level"), F.when(F.col("made") == 0, F.col("ref")).alias("product_id"), F.when(F.col("made") == 1, F.col("ref")).alias("made_by"),
        ((action == "new") & F.col("price").isNotNull() | (action == "changed") & other).alias("price_point"),
    )


def import_counters(outcomes: DataFrame) -> DataFrame:
    """(received, created, duplicates, updated, unchanged, price_points) over a batch's outcomes; unchanged ones count as ignored, not as updated."""
    count = lambda a: F.count_if(F.col("action") == a)
    return outcomes.agg(F.count("*").alias("received"), count("new").alias("created"), count("duplicate").alias("duplicates"), count("changed").alias("updated"), count("unchanged").alias("unchanged"), F.count_if("price_point").alias("price_points"))


def ingested_catalogue(catalogue: DataFrame, batch: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The catalogue after the batch: (id, made_by, origin, content_hash, price, first_seen, last_seen, history).

    ``catalogue`` has origin, first_seen, last_seen and history (array of (seen, price))
    too, ``batch`` a time ``seen``. Products keep id, origin, first_seen and history; the
    last new or changed listing gives content and price, any match last_seen. New
    products have a null id and ``made_by``, origin scraped. Histories keep their newest
    ``HISTORY`` points.
    """
    seen = outcomes.join(batch.select("seq", "content_hash", F.col("price").cast("double").alias("price"), "seen"), "seq")
    keys = [F.col("product_id").alias("id"), F.col("made_by")]
    applied = F.when(F.col("action").isin("new", "changed"), F.col("seq"))
    gist = seen.groupBy(*keys).agg(
        F.max_by(F.struct("content_hash", "price"), applied).alias("content"), F.min("seen").alias("first"), F.max("seen").alias("last"), F.max(applied).alias("applied"),
    )
    newest = Window.partitionBy("id", "made_by").orderBy(F.desc("seq"))
    points = seen.where("price_point").select(*keys, "seq", "seen", "price").withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= HISTORY)
    points = points.groupBy("id", "made_by").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "seen", "price"))), lambda p: F.struct(p["seen"].alias("seen"), p["price"].alias("price"))).alias("points"))
    both = lambda a, b: F.expr(f"{a}.id <=> {b}.id AND {a}.made_by <=> {b}.made_by")
    changes = gist.alias("g").join(points.alias("p"), both("g", "p"), "left").select("g.*", "p.points")
    old = catalogue.withColumn("made_by", F.lit(None).cast("long"))
    every = old.alias("o").join(changes.alias("c"), both("o", "c"), "full")
    history = F.concat(F.coalesce("o.history", F.array().cast("array<struct<seen:timestamp,price:double>>")), F.coalesce("c.points", F.array().cast("array<struct<seen:timestamp,price:double>>")))
    kept = F.when(F.size(history) > HISTORY, F.slice(history, -HISTORY, HISTORY)).otherwise(history)
    newer = F.col("c.applied").isNotNull()
    return every.select(
        F.coalesce("o.id", "c.id").alias("id"), F.col("c.made_by").alias("made_by"), F.coalesce("o.origin", F.lit("scraped")).alias("origin"),
        F.when(newer, F.col("c.content.content_hash")).otherwise(F.col("o.content_hash")).alias("content_hash"), F.when(newer, F.col("c.content.price")).otherwise(F.col("o.price")).alias("price"),
        F.coalesce("o.first_seen", "c.first").alias("first_seen"), F.coalesce("c.last", "o.last_seen").alias("last_seen"), kept.alias("history"),
    )
