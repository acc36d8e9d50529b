"""A Merkle manifest of a document table, with a proof for every row (operator 12).

Trees have a fan-out of ``FAN``: one per language over its leaves in id order, one over their roots.

1. Leaves are hashed and numbered within their language (range partitions, no sort of the whole).
2. A *superblock*, ``FAN ** LEVELS`` consecutive leaves, is reduced to its top node in one task. A
   language of any size is spread over its superblocks.
3. What is above the superblocks is a small table, reduced level by level by grouping runs of
   ``FAN`` nodes; the roots of the languages are reduced alike.
4. Exchange: each superblock's leaves are cogrouped with the *outer nodes* it needs, the siblings
   on the way from its top node to the root. There its subtree is reduced, proofs are joined
   from inner and outer siblings, and tampered leaves are folded up to a root.

Only ids, languages and digests are shuffled, never texts. A group holds one superblock at most.
"""

from __future__ import annotations

import sys
from hashlib import sha256

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ordering import RANGE_ROWS, with_start
from corpusmill.storage import materialise

FAN = 8
LEVELS = 4  # of a superblock: 4,096 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# the functions below travel with the task: executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts laid end to end."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def lowered(text: Column) -> Column:
    """Only A to Z change, unlike in ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def tampered_rows(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed): ``tree`` orders languages bytewise, null first;
    ``changed`` is the tampered leaf, or the leaf itself."""
    def leaf(text):
        return digest(*[framed(text if name == "text" else F.col(name)) for name in FIELDS])

    text = F.col("text")
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("tree"), "doc_id",
        leaf(text).alias("leaf"),
        F.when(tampered_rows(F.col("doc_id")), leaf(lowered(text))).alias("changed"))


def parent(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def reduce_block(leaves: list[str], only: bool) -> list[list[str]]:
    """The levels of a superblock, leaves first. The ``only`` superblock of a tree ends where one
    node remains; others go up LEVELS levels, even from a single leaf."""
    levels = [leaves]
    while len(levels) <= LEVELS and (len(levels[-1]) > 1 or not only):
        nodes = levels[-1]
        levels.append([parent(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)])
    return levels


def _tops(numbered: DataFrame) -> DataFrame:
    """(tree, block, digest): the top node of every superblock."""
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        leaves = rows.sort_values("start")["leaf"].tolist()
        only = key[1] == 0 and len(leaves) < FAN ** LEVELS  # a full first one is equal either way
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]],
                             "digest": [reduce_block(leaves, only)[-1][0]]})

    return numbered.select("tree", "block", "start", "leaf").groupBy("tree", "block").applyInPandas(
        run, "tree string, block long, digest string")


def climb(nodes: DataFrame, label: str) -> tuple[DataFrame, DataFrame, int]:
    """Reduce trees of nodes (tree, place, digest), places from 0 without gaps; a written table.

    Returns the roots (tree, digest), the runs (tree, level, run, nodes) that were hashed, and how
    many levels these have. A level is one grouping of a table an eighth as large as the last.
    """
    level, roots, runs = 0, [], []
    while True:
        counted = nodes.groupBy("tree").agg(F.max("place").alias("last"))
        roots.append(nodes.join(counted.filter("last = 0"), "tree").select("tree", "digest"))
        if not (counted.agg(F.max("last")).first()[0] or 0):
            break
        hashed = materialise(
            nodes.join(counted.filter("last > 0").select("tree"), "tree")
            .groupBy("tree", F.floor(F.col("place") / FAN).alias("run"))
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))),
                             lambda n: n["digest"]).alias("nodes")), f"{label}-runs")
        runs.append(hashed.select("tree", F.lit(level).alias("level"), "run", "nodes"))
        nodes = hashed.select("tree", F.col("run").alias("place"),
                              digest(F.array_join("nodes", "")).alias("digest"))
        level += 1
    every = roots[0]
    for part in roots[1:]:
        every = every.unionByName(part)
    found = nodes.select("tree", F.lit(0).alias("level"), F.col("place").alias("run"),
                         F.array("digest").alias("nodes")).limit(0)
    for part in runs:
        found = found.unionByName(part)
    return every, found, level


def outer_nodes(blocks: DataFrame, runs: DataFrame, levels: int, above: int) -> DataFrame:
    """For nodes (tree, block, place): the run of every level on the way to the root, and the
    node's place in it, as (tree, block, level, place, nodes); levels count from ``above``."""
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(max(levels - 1, 0))), lambda k: F.struct(
        k.alias("level"), F.floor(F.col("place") / F.pow(F.lit(FAN), k)).alias("at"))))
    way = blocks.select("tree", "block", steps.alias("_s")).select(
        "tree", "block", "_s.level", F.floor(F.col("_s.at") / FAN).alias("run"),
        (F.col("_s.at") % FAN).cast("int").alias("place"))
    return way.join(runs, ["tree", "level", "run"]).select(
        "tree", "block", (F.col("level") + F.lit(above)).alias("level"), "place", "nodes")


RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, " \
         "verified boolean"


def finish(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs and folds of one superblock. ``outer`` has a row per level above it (level, place,
    nodes), and one of level -1 that says how many of these stay below the subroot."""
    leaves = leaves.sort_values("start")
    outer = outer.sort_values("level")
    below = int(outer["place"].iloc[0])
    way = [(list(n), int(p)) for n, p in zip(outer["nodes"], outer["place"])][1:]
    only = below == 0 and len(leaves) < FAN ** LEVELS
    levels = reduce_block(leaves["leaf"].tolist(), only)

    subroot = root = levels[-1][0]
    tail = []
    for k, (nodes, place) in enumerate(way):
        tail += nodes[:place] + nodes[place + 1:]
        root = parent(nodes[:place] + [root] + nodes[place + 1:])
        if k + 1 == below:
            subroot = root
    rest = "".join(tail).encode()

    inner = []  # of each level: what stands left and right of a node in its run
    for nodes in levels[:-1]:
        around = []
        for i in range(0, len(nodes), FAN):
            run = nodes[i:i + FAN]
            around += [("".join(run[:k]), "".join(run[k + 1:])) for k in range(len(run))]
        inner.append(around)
    outside = [("".join(n[:p]), "".join(n[p + 1:])) for n, p in way]

    proofs, folds, memo = [], [], {}
    for i, (leaf, changed) in enumerate(zip(leaves["leaf"], leaves["changed"])):
        siblings, at, node = [], i, changed if isinstance(changed, str) else leaf
        for around in inner:
            left, right = around[at]
            siblings += (left, right)
            node = sha256((left + node + right).encode()).hexdigest()
            at //= FAN
        proofs.append(sha256("".join(siblings).encode() + rest).hexdigest())
        if node not in memo:  # nodes that agree at the top of the superblock agree from there on
            top = node
            for left, right in outside:
                top = sha256((left + top + right).encode()).hexdigest()
            memo[node] = top
        folds.append(memo[node])
    out = pd.DataFrame({"doc_id": leaves["doc_id"].to_numpy(), "leaf": leaves["leaf"].to_numpy()})
    return out.assign(subroot=subroot, root=root, proof_sha256=proofs, folded_root=folds,
                      verified=[f == root for f in folds])


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are not looked at. Null ids
    come first in their language and are never tampered with. Rows of one id follow each other by
    digest; equal rows are leaves of their own. An empty table gives no rows. A tree of one leaf has
    that leaf as its subroot, one language's subroot is the root, and a leaf without siblings has
    the proof of nothing. Whole texts are hashed, however long.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    leaves = materialise(leaves_of(docs), "leaves")
    # equal rows are told apart by where they are stored, so that ranges can split them
    ordered = leaves.withColumn("_order", F.struct(
        "doc_id", "leaf", F.monotonically_increasing_id().alias("row")))
    ranges = leaves.count() // RANGE_ROWS + 1
    numbered = materialise(
        with_start(ordered, ["tree"], "_order", F.lit(1), ranges).drop("_order")
        .withColumn("block", F.floor(F.col("start") / FAN ** LEVELS)), "numbered-leaves")

    tops = materialise(_tops(numbered), "superblocks")
    subroots, runs, steps = climb(
        tops.select("tree", F.col("block").alias("place"), "digest"), "trees")
    subroots = materialise(subroots, "subroots")
    langs = with_start(subroots.withColumn("all", F.lit("")), ["all"], "tree", F.lit(1),
                       subroots.count() // RANGE_ROWS + 1)
    langs = materialise(langs.select(
        "all", "tree", F.col("start").alias("place"), "digest"), "languages")
    _, top_runs, top_steps = climb(
        langs.select(F.col("all").alias("tree"), "place", "digest"), "languages")

    high = runs.groupBy("tree").agg(F.max("level").alias("level"))
    below = tops.select("tree", "block").join(high, "tree", "left").select(
        "tree", "block", F.lit(-1).alias("level"),
        F.coalesce(F.col("level") + 1, F.lit(0)).cast("int").alias("place"),
        F.array().cast("array<string>").alias("nodes"))
    own = outer_nodes(tops.select("tree", "block", F.col("block").alias("place")), runs, steps, 0)
    # the way of a language to the root is brought to each of its superblocks
    common = outer_nodes(
        langs.select(F.col("all").alias("tree"), F.col("tree").alias("block"), "place"),
        top_runs, top_steps, steps).select(
        F.col("block").alias("tree"), "level", "place", "nodes")
    outer = below.unionByName(own).unionByName(
        tops.select("tree", "block").join(common, "tree").select(*below.columns))

    # ids travel as text, as pandas would turn whole numbers beside nulls into fractions
    done = (numbered.select("tree", "block", "start", F.col("doc_id").cast("string"), "leaf", "changed")
            .groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
            .applyInPandas(finish, f"doc_id string, {RESULT}"))
    return done.withColumn("doc_id", F.col("doc_id").cast(id_type))
