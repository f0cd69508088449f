"""Connected components by min-label propagation with pointer jumping, each round a saved table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vcspark.operators.skew import BROADCAST_KEYS, salted_join
from vcspark.sources.shared import drop_shared, save_shared


def _salted_step(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One round: (id, component, n, before)."""
    near = salted_join(edges, labels.select(F.col("id").alias("src"), "component", "n"), ["src"], "n", "dst").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("least"))
    users = labels.groupBy(F.col("component").alias("pointer")).agg(F.count("*").alias("users"))
    target = labels.select(F.col("id").alias("pointer"), F.col("component").alias("next")).join(users, "pointer")
    jumped = salted_join(labels.withColumn("pointer", F.col("component")), target, ["pointer"], "users", "id")
    return jumped.join(near, "id").select("id", F.least("component", "least", "next").alias("component"), "n", F.col("component").alias("before"))


def _broadcast_step(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The same round where all labels fit every task."""
    of = lambda key, value: F.broadcast(labels.select(F.col("id").alias(key), F.col("component").alias(value)))
    near = edges.join(of("src", "met"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("met").alias("least"))
    own = near.join(F.broadcast(labels), "id").join(of("component", "next"), "component")
    return own.select("id", F.least("component", "least", "next").alias("component"), "n", F.col("component").alias("before"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``: the smallest id that can be reached.

    Rounds, one job each: an id takes the smallest of its label, its neighbours' labels
    and its label's label, until none changes (about the logarithm of the longest
    path). Only whether one did reaches the driver. An id with very many links, and a
    label with very many ids, is dealt over many tasks. Up to ``BROADCAST_KEYS`` ids'
    labels go to all tasks instead, then a round has one shuffle, of the least labels
    met. Links with a null end, and links to itself, join nothing.
    """
    sound = links.where(f"{a} is not null and {b} is not null and {a} <> {b}")
    both = sound.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(sound.select(F.col(b), F.col(a))).distinct()
    edges = save_shared(both, "cc-edges")
    labels = save_shared(edges.groupBy("src").agg(F.least("src", F.min("dst")).alias("component"), F.count("*").alias("n")).withColumnRenamed("src", "id"), "cc-labels")
    step = _broadcast_step if labels.count() <= BROADCAST_KEYS else _salted_step
    while True:
        after = save_shared(step(edges, labels), "cc-labels")
        drop_shared(labels)
        if after.where("component <> before").isEmpty():
            drop_shared(edges)
            return after.select("id", "component")
        labels = after.drop("before")
        labels._shared_path = after._shared_path
