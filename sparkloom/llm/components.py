"""Consolidating pairwise links into groups (problem 2).

Method: rake and compress, then a reduced core, then restoring. Each round looks at the vertices with at most two neighbours
and removes those whose priority is the smallest among such neighbours (the independent sets of parallel list ranking): a
vertex of degree one is stripped, one of degree two is spliced out of its chain and its neighbours are linked; either keeps
one neighbour as its parent. Stars go in one round, a chain loses a third of its vertices a round, so the rounds are
logarithmic. When a round no longer removes an eighth of what lives, the rest (all cycles and dense parts) is solved by
alternating large-star and small-star steps, and the removed vertices get their labels back, last round first.

Scale: rounds shuffle only what still lives; degrees, priorities and minima are aggregated on the map side, so a hub costs a
row per task; edges are dropped and added by one aggregation on both ends, which no hub skews. Each round is written to the
shared checkpoint folder.

Defined results: a link of a vertex with itself joins nothing and is dropped; repeated links, either order, count once; null
ends are no links; an empty table gives no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.lineage import cut

WORTH_A_ROUND = 8


def canonical(links: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct undirected edges (u < v)."""
    return (
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .distinct()
    )


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _strip(edges: DataFrame, salt: int) -> DataFrame:
    """The vertices this round removes: (vertex, parent, other); ``other`` is null for a stripped leaf."""
    low = (
        both_ways(edges)
        .groupBy(F.col("u").alias("vertex"))
        .agg(F.count(F.lit(1)).alias("degree"), F.min("v").alias("parent"), F.max("v").alias("far"))
        .where("degree <= 2")
        .withColumn("priority", F.struct(F.xxhash64("vertex", F.lit(salt)), F.col("vertex")))
    )
    heard = (
        low.select(F.explode(F.array_distinct(F.array("parent", "far"))).alias("vertex"), F.col("priority").alias("least"))
        .groupBy("vertex")
        .agg(F.min("least").alias("least"))
    )
    return (
        low.join(heard, "vertex", "left")
        .where(F.col("least").isNull() | (F.col("priority") < F.col("least")))
        .select("vertex", "parent", F.when(F.col("degree") == 2, F.col("far")).alias("other"))
    )


def _without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges after removing vertices and linking the two neighbours of each that was spliced out."""
    dead = removed.select("vertex", F.explode(F.array_compact(F.array("parent", "other"))).alias("to"))
    tagged = (
        edges.select("u", "v", F.lit(0).alias("dead"))
        .unionByName(dead.select(F.least("vertex", "to").alias("u"), F.greatest("vertex", "to").alias("v"), F.lit(1).alias("dead")))
        .unionByName(removed.where("other is not null").select(F.least("parent", "other").alias("u"), F.greatest("parent", "other").alias("v"), F.lit(0).alias("dead")))
    )
    return tagged.groupBy("u", "v").agg(F.max("dead").alias("dead")).where("dead = 0").select("u", "v")


def _core_labels(edges: DataFrame) -> DataFrame:
    """(vertex, label) of the reduced core by large-star and small-star steps, until every edge points at its group's least."""
    while True:
        ways = both_ways(edges)
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = cut(canonical(large, "a", "b"))
        down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # from the larger end to the smaller
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        after = cut(canonical(small, "a", "b"))
        # done when it is a set of stars: no vertex is both a centre and a leaf, and each leaf has one centre
        roles = after.select(F.col("u").alias("x"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).unionByName(
            after.select(F.col("v").alias("x"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))
        busy = roles.groupBy("x").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf")).where("leaf > 1 or (leaf = 1 and centre = 1)")
        if busy.isEmpty():
            return after.select(F.col("v").alias("vertex"), F.col("u").alias("label")).unionByName(after.select("u", "u").distinct().toDF("vertex", "label"))
        edges = after


def connected_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(group, vertex): every linked vertex with the least vertex of its group; the least comes with itself."""
    edges = cut(canonical(links, a, b))
    rounds: list[DataFrame] = []
    living = edges.count()
    while living:
        removed = cut(_strip(edges, len(rounds)))
        gone = removed.count()
        if not gone:
            break
        rounds.append(removed)
        edges = cut(_without(edges, removed))
        before, living = living, edges.count()
        if gone * WORTH_A_ROUND < before:
            break
    labels = _core_labels(edges) if living else edges.toDF("vertex", "label")
    for removed in reversed(rounds):
        # a parent without a label was the last of its group: it labels itself
        found = removed.select("vertex", "parent").join(labels.withColumnRenamed("vertex", "parent"), "parent", "left")
        found = found.select("vertex", "parent", F.coalesce("label", "parent").alias("label"), F.col("label").isNull().alias("root"))
        roots = found.where("root").select(F.col("parent").alias("vertex"), F.col("parent").alias("label")).distinct()
        labels = cut(labels.unionByName(found.select("vertex", "label")).unionByName(roots))
    least = labels.groupBy("label").agg(F.min("vertex").alias("group"))
    return labels.join(least, "label").select("group", "vertex")
