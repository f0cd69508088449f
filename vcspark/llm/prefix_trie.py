"""The trie of conversations by their turns, merged family by family first.

A conversation is rebuilt from the first turns of its family's base conversation and its
own later ones. Conversations are cogrouped with the base's first turns by base id; each
family builds its small trie, and only the family's combined nodes are shuffled to be
merged over all families. What a node sums over its subtree is summed in the family
tries too, each node of the whole trie counted by the family of its smallest member.

A node is named by its depth and the exclusive or of two 60-bit digests of each (depth,
turn) on its path. A conversation longer than ``BAND`` turns takes part in one group for
each band of that many depths, so no group holds more than a family's share of a band.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vcspark.llm.mixing import word_count
from vcspark.operators.skew import BROADCAST_ROWS, salted_join
from vcspark.sources.shared import save_shared

BAND = 4096
FAMILY = 20
HEAD = 3
#: Base ids whose members' ids are joined to one text before the last digest.
_ENDS_SPAN = 1024 * FAMILY
_NODE = ["depth", "a", "b"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _small(df: DataFrame) -> DataFrame:
    """A saved table, broadcast if its rows (some dozen bytes each) are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered_turns(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """(conv, pos, n, long, item, words): turns by place; ``long`` marks conversations of over ``band`` turns.

    Turns go by ``turn`` (null first), equal ones by the digest of role and text. Long
    conversations are numbered in parts, cut by ``turn``, so that tasks share one.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    item = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), item.alias("item"), word_count(text).alias("words")).where("conv is not null")
    sizes = rows.groupBy("conv").agg(F.count("*").alias("total"), F.min("turn").alias("least"), F.max("turn").alias("most"))
    long = save_shared(sizes.where(F.col("total") > band), "trie-long")
    part = F.when(F.col("total").isNull() | F.col("turn").isNull(), 0).otherwise(1 + F.floor((F.col("turn").cast("double") - F.col("least")) / (F.col("most").cast("double") - F.col("least") + 1) * F.ceil(F.col("total") / band)))
    rows = rows.join(_small(long), "conv", "left").withColumn("part", part.cast("long"))
    within = Window.partitionBy("conv", "part")
    placed = rows.select(
        "conv", "part", "item", "words", F.col("total").isNotNull().alias("long"),
        (F.row_number().over(within.orderBy(F.asc_nulls_first("turn"), "item")).cast("long") - 1).alias("pos"),
        F.coalesce("total", F.count("*").over(within)).alias("n"),
    )
    if not long.isEmpty():
        counts = rows.where("total is not null").groupBy("conv", "part").agg(F.count("*").alias("here"))
        starts = counts.select("conv", "part", (F.sum("here").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")).alias("start"))
        placed = placed.join(_small(save_shared(starts, "trie-parts")), ["conv", "part"], "left").withColumn("pos", F.col("pos") + F.coalesce("start", F.lit(0)))
    return placed.select("conv", "pos", "n", "long", "item", "words")


def _taken(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 4


def _marks(depth: Column, item: Column) -> list[Column]:
    """What ``_mark`` gives in Python."""
    digest = F.sha2(F.concat(depth.cast("string").cast("binary"), F.lit(b":"), item), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def _mark(depth: int, item: bytes) -> tuple[int, int]:
    digest = hashlib.sha256(b"%d:" % depth + item).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def _entries(turns: DataFrame, heads: DataFrame, band: int) -> tuple[DataFrame, DataFrame]:
    """Of long conversations, their shift of places and the node before each band after the first."""
    of = turns.where("long").select("conv").distinct()
    shifts = of.join(heads.groupBy(F.col("base").alias("of_base")).agg(F.count("*").alias("held")), F.expr(f"conv - conv % {FAMILY}") == F.col("of_base"), "left")
    shift = F.least(_taken(F.col("conv")), F.coalesce("held", F.lit(0))) - _taken(F.col("conv"))
    shifts = save_shared(shifts.select("conv", shift.cast("long").alias("shift")), "trie-shifts")
    own = turns.where("long").join(_small(shifts), "conv").where(F.col("pos") >= _taken(F.col("conv"))).select("conv", (F.col("pos") + F.col("shift") + 1).alias("depth"), "item")
    lent = shifts.join(heads, F.expr(f"conv - conv % {FAMILY}") == F.col("base")).where(F.col("pos") < _taken(F.col("conv"))).select("conv", (F.col("pos") + 1).alias("depth"), "item")
    a, b = _marks(F.col("depth"), F.col("item"))
    whole = own.union(lent).select("conv", F.expr(f"(depth - 1) div {band}").alias("band"), a.alias("a"), b.alias("b"))
    by_band = whole.groupBy("conv", "band").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    entered = by_band.select("conv", "band", F.bit_xor("a").over(before).alias("a"), F.bit_xor("b").over(before).alias("b")).where("band > 0")
    return shifts, save_shared(entered, "trie-entries")


_FAMILY_SCHEMA = "base long, band long, depth long, a long, b long, above_a long, above_b long, words long, members long, conv long, ends array<long>"


def _family_tries(turns: DataFrame, band: int) -> tuple[DataFrame, DataFrame | None]:
    """The nodes of each family's trie (by band), and the nodes at which long conversations enter further bands."""
    heads = save_shared(turns.where(f"conv % {FAMILY} = 0 and pos < {HEAD}").select(F.col("conv").alias("base"), "pos", "item", "words"), "trie-heads")
    base = F.col("conv") - F.col("conv") % FAMILY
    plain = turns.withColumns({"base": base, "band": F.lit(0).cast("long"), "taken": _taken(F.col("conv")), "depth": F.lit(None).cast("long"), "a": F.lit(None).cast("long"), "b": F.lit(None).cast("long")})
    columns = ["base", "band", "conv", "taken", "n", "pos", "depth", "item", "words", "a", "b"]
    entries = None
    left = plain.select(*columns)
    if not turns.where("long").isEmpty():
        shifts, entries = _entries(turns, heads, band)
        depth = F.when(F.col("shift").isNotNull() & (F.col("pos") >= F.col("taken")), F.col("pos") + F.col("shift") + 1)
        dealt = plain.join(_small(shifts), "conv", "left").withColumn("depth", depth).withColumn("band", F.coalesce(F.expr(f"(depth - 1) div {band}"), F.lit(0)).cast("long"))
        nothing = F.lit(None)
        entered = entries.select(base.alias("base"), "band", "conv", _taken(F.col("conv")).alias("taken"), nothing.cast("long").alias("n"), nothing.cast("long").alias("pos"), (F.col("band") * band).alias("depth"), nothing.cast("binary").alias("item"), F.lit(0).cast("long").alias("words"), "a", "b")
        left = dealt.select(*columns).union(entered)

    def family(key: tuple[pa.Scalar, ...], own: pa.Table, first: pa.Table) -> pa.Table:
        base_id, number = key[0].as_py(), key[1].as_py()
        heads = sorted((r["pos"], r["item"], r["words"]) for r in first.to_pylist())
        by_conv: dict[int, list[dict]] = defaultdict(list)
        for row in own.to_pylist():
            by_conv[row["conv"]].append(row)
        nodes: dict[tuple[int, int, int], list] = {}
        for conv in sorted(by_conv):
            rows = by_conv[conv]
            later = sorted((r for r in rows if r["pos"] is not None and r["pos"] >= r["taken"]), key=lambda r: r["pos"])
            sequence = [(r["item"], r["words"]) for r in later]
            if number == 0:
                lent = heads[: rows[0]["taken"]]
                sequence = [(item, words) for _, item, words in lent] + sequence
                length = len(lent) + max(0, rows[0]["n"] - rows[0]["taken"])
                at = (0, 0, 0)
                path = [(at, at, 0)]
            else:
                entry = next(r for r in rows if r["pos"] is None)
                at = (entry["depth"], entry["a"], entry["b"])
                length = later[0]["depth"] - later[0]["pos"] - 1 + later[0]["n"]
                path = []
            for item, words in sequence:
                a, b = _mark(at[0] + 1, item)
                below = (at[0] + 1, at[1] ^ a, at[2] ^ b)
                path.append((below, at, words))
                at = below
            for node, above, words in path:
                held = nodes.setdefault(node, [above, words, 0, conv, []])
                held[2] += 1
            if at[0] == length:
                nodes[at][4].append(conv)
        columns = zip(*[(base_id, number, *node, *above[1:], words, members, conv, ends) for node, (above, words, members, conv, ends) in nodes.items()])
        kinds = [pa.int64()] * 10 + [pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _FAMILY_SCHEMA.split(", ")])

    right = heads.withColumn("band", F.lit(0).cast("long"))
    made = left.groupBy("base", "band").cogroup(right.groupBy("base", "band")).applyInArrow(family, _FAMILY_SCHEMA)
    return made, entries


def _ends(family: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of nodes that conversations end in.

    Families follow each other in the order of their ids. Their ids are joined to texts of
    bounded size, and one pass over a node's texts in order makes its digest, which needs
    no more than a text at a time.
    """
    texts = family.where(F.size("ends") > 0).select(*_NODE, "base", F.array_join(F.sort_array("ends").cast("array<string>"), ",").alias("ends"))
    span = F.floor(F.col("base") / _ENDS_SPAN)
    spans = texts.groupBy(*_NODE, span.alias("span")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda t: t["ends"]), ",").alias("ends"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for part in parts:
            done = []
            for row in part.to_pylist():
                node = (row["depth"], row["a"], row["b"])
                if node != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(row["ends"].encode())
                else:
                    digest.update(b"," + row["ends"].encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*_NODE, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, digest.hexdigest())], names=[*_NODE, "ends_sha256"])

    return spans.repartition(*_NODE).sortWithinPartitions(*_NODE, "span").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


_SUMS_SCHEMA = "depth long, a long, b long, parent long, saved long, leaves long"


def _family_sums(key: tuple[pa.Scalar, ...], own: pa.Table, more: pa.Table) -> pa.Table:
    """What the family's part of each subtree saves and how many leaves it has; ``more`` comes from other bands."""
    rows = own.to_pylist()
    held = {(r["depth"], r["a"], r["b"]): [r["conv_id"], r["saved"], r["leaves"]] for r in rows}
    parents = {(r["depth"], r["a"], r["b"]): r["conv_id"] for r in more.to_pylist() if r["conv_id"] is not None}
    for r in more.to_pylist():
        if r["conv_id"] is None:
            sums = held[r["depth"], r["a"], r["b"]]
            sums[1] += r["saved"]
            sums[2] += r["leaves"]
    out = []
    for r in sorted(rows, key=lambda r: -r["depth"]):
        node, above = (r["depth"], r["a"], r["b"]), (r["depth"] - 1, r["above_a"], r["above_b"])
        conv_id, saved, leaves = held[node]
        parent = None
        if r["depth"]:
            if above in held:
                parent = held[above][0]
                held[above][1] += saved
                held[above][2] += leaves
            else:
                parent = parents[above]
        out.append((*node, parent, saved, leaves))
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in _SUMS_SCHEMA.split(", ")])


def conversation_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, a null turn comes first; equal turns of a
    conversation, repeated rows too, are all turns of it, by the digest of role and text.
    Rows without a conv_id belong to no conversation. Other columns aren't read. A
    negative id's base is the next multiple of 20 towards zero. Without conversations
    there is no node, not even the root.
    """
    turns = save_shared(numbered_turns(conversations, band), "trie-turns")
    made, entries = _family_tries(turns, band)
    family = save_shared(made, "trie-family")
    merged = family.groupBy(*_NODE).agg(F.sum("members").alias("n_convs"), F.min("conv").alias("conv_id"), F.count("*").alias("families"), *[F.first(c).alias(c) for c in ("above_a", "above_b")])
    merged = save_shared(merged, "trie-nodes")
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("a"), F.col("above_b").alias("b")).agg(F.count("*").alias("n_children"))
    whole = save_shared(merged.join(children, _NODE, "left").select(*_NODE, "families", "n_convs", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children")), "trie-whole")
    known = salted_join(family.drop("ends", "members"), whole, _NODE, "families", "base")
    mine = F.expr(f"conv_id - conv_id % {FAMILY}") == F.col("base")
    known = known.withColumns({"saved": F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0), "leaves": F.when(mine & (F.col("n_children") == 0), 1).otherwise(0).cast("long")})
    known = save_shared(known.select("base", "band", *_NODE, "above_a", "above_b", "conv_id", "saved", "leaves"), "trie-known")
    more = _from_other_bands(known, entries, band)
    sums = known.groupBy("base", "band").cogroup(more.groupBy("base", "band")).applyInArrow(_family_sums, _SUMS_SCHEMA)
    total = sums.groupBy(*_NODE).agg(F.max("parent").alias("parent_conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = _ends(family).select(*_NODE, "ends_sha256")
    out = whole.join(total, _NODE).join(ends, _NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def _from_other_bands(known: DataFrame, entries: DataFrame | None, band: int) -> DataFrame:
    """(base, band, depth, a, b, conv_id, saved, leaves) for families with long conversations.

    With a conv_id: the node of the band before that a band's first nodes hang on.
    Without: what deeper bands add to a node. A node's sums go by its smallest member, so
    adding them up along conversations counts each once.
    """
    spark = known.sparkSession
    if entries is None:
        return spark.createDataFrame([], "base long, band long, depth long, a long, b long, conv_id long, saved long, leaves long")
    base = F.col("conv") - F.col("conv") % FAMILY
    placed = entries.select("conv", base.alias("base"), "band", (F.col("band") * band).alias("depth"), "a", "b")
    ids = known.select(*_NODE, "conv_id").join(_small(save_shared(placed.select(*_NODE).distinct(), "trie-hooks")), _NODE, "left_semi").groupBy(*_NODE).agg(F.first("conv_id").alias("conv_id"))
    above = placed.select("base", "band", *_NODE).distinct().join(ids, _NODE).select("base", "band", *_NODE, "conv_id", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"))
    owned = known.where("band > 0 and (saved > 0 or leaves > 0)").groupBy(F.col("conv_id").alias("conv"), "band").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    onward = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    below = placed.join(owned, ["conv", "band"], "left").select("conv", "base", "band", *_NODE, F.sum(F.coalesce("saved", zero)).over(onward).alias("saved"), F.sum(F.coalesce("leaves", zero)).over(onward).alias("leaves"))
    below = below.groupBy("base", (F.col("band") - 1).alias("band"), *_NODE).agg(F.lit(None).cast("long").alias("conv_id"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    return above.union(below)
