"""Group fingerprints that are kept, so that a run recomputes what its changes touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.fingerprints import (
    WIDTHS, hash_nodes, leaf_lines, leaf_of, node_lines)
from corpusmill.operators.lookup import fetch, without
from corpusmill.sources.tables import KeyedTable
from corpusmill.storage import materialise, observed

# Up to so many touched names are put into the scan; more of them touch most files anyway.
PUSHED_NAMES = 256


class FingerprintTree:
    """The tree of ``merkle_fingerprint`` as two tables: file hashes, and the hashes of all nodes.

    ``update`` takes the files that changed and reads only the leaves these lie in, the other
    children of their branches, and those of their roots. ``sync`` takes all files and finds out
    what changed. ``roots`` gives the fingerprints, equal to those of the full computation.

    Files are rows (grp, rel, hash), each (grp, rel) once, none of them null. A group whose last
    file goes has no fingerprint. Nodes are saved before file hashes: a run that dies between the
    two finds the same changes again and writes the same nodes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.files = KeyedTable(spark, f"{root}/files", ["grp", "node", "rel"],
                                "grp string, node string, rel string, hash string", ["node"])
        self.nodes = KeyedTable(spark, f"{root}/nodes", ["grp", "width", "node"],
                                "grp string, width int, node string, hash string",
                                ["width", "node"])

    def roots(self) -> DataFrame:
        """(grp, fingerprint) of every group."""
        return self.nodes.read(F.col("width") == 0).select(
            "grp", F.col("hash").alias("fingerprint"))

    def sync(self, current: DataFrame) -> dict[str, int]:
        """Make the tree that of the ``current`` files; only paths and hashes are joined."""
        current = current.select("grp", "rel", "hash")
        if self.files.is_new():
            return self.update(current)
        known = self.files.read().select("grp", "rel", F.col("hash").alias("old"))
        differs = current.join(known, ["grp", "rel"], "full").where(
            ~F.col("hash").eqNullSafe(F.col("old")))
        return self._apply(differs.select("grp", "rel", "hash"))

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
        """Put in ``changed`` files (grp, rel, hash) and take out ``removed`` ones (grp, rel).
        Returns how many files these are, the leaves they touch, and the files of these leaves."""
        delta = changed.select("grp", "rel", "hash")
        if removed is not None:
            delta = delta.unionByName(removed.select(
                "grp", "rel", F.lit(None).cast("string").alias("hash")))
        return self._apply(delta)

    def _apply(self, delta: DataFrame) -> dict[str, int]:
        """``delta`` holds changed files, and removed ones with a null hash."""
        delta = materialise(delta.withColumn("node", leaf_of(F.col("rel"))), "tree-delta",
                            {"files": F.count(F.lit(1))}, measured=True)
        counts = {"files": observed(delta)["files"], "leaves": 0, "lines": 0}
        if not counts["files"] and not self.nodes.is_new():
            return counts
        fresh = self.nodes.is_new()
        present = delta.where(F.col("hash").isNotNull())
        key, saved, gone = ["grp", "node"], [], []
        old, new, lines = delta.select(*key, "rel"), present, leaf_lines(present, "grp")
        for width in WIDTHS:
            parent = F.substring("node", 1, width)
            touched = materialise(old.select("grp", parent.alias("node")).distinct(), "tree-touched",
                                  {"leaves": F.count(F.lit(1))}, measured=True)
            if not fresh:
                beside = without(
                    fetch(self._children(width, touched).withColumn("child", F.col("node"))
                          .withColumn("node", parent), touched, key)
                    .withColumn("node", F.col("child")).drop("child"),
                    old, old.columns)
                lines = lines.unionByName(
                    leaf_lines(beside, "grp") if width == WIDTHS[0]
                    else node_lines(beside, "grp", width))
            level = materialise(hash_nodes(lines, "grp"), "tree-nodes",
                                {"lines": F.sum("n")}, measured=True)
            if width == WIDTHS[0]:
                counts |= {"leaves": observed(touched)["leaves"],
                           "lines": observed(level)["lines"] or 0}
            at = F.lit(width).alias("width")
            saved.append(level.select("grp", at, "node", "hash"))
            gone.append(without(touched, level.select(key), key).select("grp", at, "node"))
            old, lines = touched, node_lines(level, "grp", max(width - 2, 0))
        self.nodes.apply(reduce(DataFrame.unionByName, saved),
                         None if fresh else reduce(DataFrame.unionByName, gone))
        self.files.apply(present, None if fresh else delta.where(
            F.col("hash").isNull()).select("grp", "node", "rel"))
        return counts

    def _children(self, width: int, touched: DataFrame) -> DataFrame:
        """Saved children of touched nodes of a width, and some others where these are many."""
        names = [r["node"] for r in touched.select("node").distinct().limit(
            PUSHED_NAMES + 1).collect()]
        few = len(names) <= PUSHED_NAMES
        if width == WIDTHS[0]:
            return self.files.read(F.col("node").isin(names) if few else None)
        return self.nodes.read(self._below(width, names if few else []))

    @staticmethod
    def _below(width: int, names: list[str]) -> Column:
        level = F.col("width") == WIDTHS[WIDTHS.index(width) - 1]
        if not width or not names:
            return level
        return level & reduce(Column.__or__, [F.col("node").startswith(n) for n in names])
