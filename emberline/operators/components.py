"""Names that mean the same thing, merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.sources.shared import materialise


def _roots(parents: DataFrame) -> DataFrame:
    """name and root of a forest of (name, parent), where a root is its own parent: steps are doubled until none changes."""
    while True:
        up = parents.select(F.col("name").alias("parent"), F.col("parent").alias("next"))
        doubled = materialise(parents.join(up, "parent").select("name", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")), "steps")
        if not doubled.where("moved").limit(1).count():
            return doubled.select("name", F.col("parent").alias("root"))
        parents = doubled.select("name", "parent")


def merged_names(pairs: DataFrame) -> DataFrame:
    """name and least, the smallest name of its class, of every name in pairs (a, b) that mean the same.

    In each round a name follows its smallest neighbour, if that is smaller, to the end of its chain; classes shrink to their
    chains' ends, which meet in the next round. Chains are shortened by doubling, so a long row of names takes few steps.
    """
    edges = materialise(pairs.where("a <> b").distinct(), "edges")
    named = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _roots(both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.col("a")).alias("parent")))
        step = roots.select(F.col("name").alias("least"), "root")
        named = roots.withColumnRenamed("root", "least") if named is None else named.join(step, "least", "left").select("name", F.coalesce("root", "least").alias("least"))
        named = materialise(named, "names")
        a, b = (roots.select(F.col("name").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
        edges = materialise(edges.join(a, "a").join(b, "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return named
