"""Connected components of large graphs by alternating stars.

Each round hangs every vertex under the smallest of its neighbours, first from the larger side,
then from the smaller one, until no edge changes; edges never outnumber those given. Rounds are
written to the shared folder, so lineage stays short and a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over distinct edges (a, b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    links = both.unionByName(turned)
    if not large:
        links = links.filter("v < u")
    lowest = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = links.join(lowest, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of the edges (a, b) that has a smaller one in its
    component, which is named by its smallest vertex. Edges may repeat, be loops, point either
    way; null ends are left out."""
    edges = edges.select("a", "b").filter("a is not null and b is not null and a != b").distinct()
    edges = materialise(edges, "edges")
    marks = None
    while True:
        edges = materialise(_star(_star(edges, True), False), "edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"),
                          F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if marks == tuple(state):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        marks = tuple(state)
