"""Embedding near-duplicates by cover-tree dual traversal (operator 6).

Exact: every pair with cosine of the threshold or more is a link, no other. Identical vectors
are one class with a weight. Class representatives are dealt to cells around pivots, large
cells are cut into blocks, and pairs of blocks whose cells' covering radii let them hold a link
are tasks. A task builds a cover tree per block (nested centres, radii halving by level) and
walks pairs of nodes from the roots: a pair of nodes too far apart for any link is pruned, one
so close that all its pairs are links is counted whole, others go on to their children. Counts
and a spanning set of links leave the task, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.components import components
from corpusmill.llm.words import uniform
from corpusmill.storage import broadcast_if_small, materialise

THRESHOLD = 0.9
BLOCK_ROWS = 8192
MAX_PIVOTS = 512
LEAF = 24
SLACK = 1e-6  # on distances: more than rounding can add up to
NARROW = 1e-5  # on cosines in single precision, which only screen
FINE = 1e-2  # covers of smaller radii need cosines in double precision


# ---- trees, inside a task -------------------------------------------------------------

class Node:
    """A centre, the points it covers (itself first), and the radius that covers them."""

    __slots__ = ("points", "radius", "children")

    def __init__(self, points, radius, children):
        self.points, self.radius, self.children = points, radius, children


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _cover(x: np.ndarray, points: np.ndarray, radius: float) -> list[np.ndarray]:
    """Greedy nested cover: groups of points within about ``radius`` of their first one."""
    groups, left, least = [], points, 1 - radius * radius / 2
    # Single precision cannot tell cosines over 1 - 1e-7 apart; 1 - FINE^2 / 2 is far from that.
    narrow = x[points].astype(np.float32 if radius >= FINE else np.float64)
    while len(left):
        batch, rest = left[:256], left[256:]
        near = narrow[:256] @ narrow[:256].T >= least
        owner = np.full(len(batch), -1)
        for i in range(len(batch)):
            if owner[i] < 0:
                owner[near[i] & (owner < 0)] = i
                owner[i] = i
        centres = np.flatnonzero(owner == np.arange(len(batch)))
        taken = np.full(len(rest), -1)
        row, column = np.nonzero(narrow[256:] @ narrow[centres].T >= least)
        taken[row[::-1]] = column[::-1]  # the first centre that covers it
        by = np.argsort(taken, kind="stable")
        ends = np.searchsorted(taken[by], np.arange(len(centres) + 1))
        for k, c in enumerate(centres):
            own = batch[owner == c]
            groups.append(np.concatenate((own, rest[by[ends[k]:ends[k + 1]]])))
        left, narrow = rest[taken < 0], narrow[256:][taken < 0]
    return groups


def build(x: np.ndarray, points: np.ndarray | None = None, level: float = 2.0) -> Node:
    """The cover tree of unit vectors; a node's first point is its centre."""
    if points is None:
        points = np.arange(len(x))
    radius = float(_distances(x[points[:1]], x[points]).max()) if len(points) > 1 else 0.0
    if len(points) <= LEAF or radius < 1e-7:
        return Node(points, radius, ())
    while level >= radius:
        level /= 2
    groups = _cover(x, points, level)
    while len(groups) == 1 and level > radius / 8:  # rounding hid the farthest point
        level /= 2
        groups = _cover(x, points, level)
    if len(groups) == 1:
        return Node(points, radius, ())
    return Node(points, radius, [build(x, g, level / 2) for g in groups])


class Links:
    """Weighted link counts per point of either side, and edges that span the links."""

    def __init__(self, x, y, weight_x, weight_y, threshold, same):
        self.x, self.y, self.wx, self.wy = x, y, weight_x, weight_y
        self.threshold, self.same = threshold, same
        self.reach = math.sqrt(2 - 2 * threshold)
        self.count_x = np.zeros(len(x), np.int64)
        self.count_y = self.count_x if same else np.zeros(len(y), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.narrow_x = x.astype(np.float32)
        self.narrow_y = self.narrow_x if same else y.astype(np.float32)

    def _all(self, p, q):
        """Every point of p links with every point of q."""
        self.count_x[p] += self.wy[q].sum()
        self.count_y[q] += self.wx[p].sum()
        self.edges.append((p, np.repeat(q[:1], len(p))))
        self.edges.append((np.repeat(p[:1], len(q)), q))

    def _all_within(self, p):
        self.count_x[p] += self.wx[p].sum() - self.wx[p]
        self.edges.append((np.repeat(p[:1], len(p)), p))

    def _masked(self, ps, qs, mask):
        """Compare the points of leaves p and q wherever ``mask`` has the pair."""
        i, j = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        rows = np.concatenate([ps[k].points for k in i])
        columns = np.concatenate([qs[k].points for k in j])
        node_p = np.repeat(i, [len(ps[k].points) for k in i])
        node_q = np.repeat(j, [len(qs[k].points) for k in j])
        for a in range(0, len(rows), 512):
            own = rows[a:a + 512]
            cosine = self.x[own] @ self.y[columns].T
            cosine[~mask[node_p[a:a + 512]][:, node_q]] = -2
            self._hits(own, columns, cosine)

    def _hits(self, rows, columns, cosine, within=False):
        hit = cosine >= self.threshold
        for i, j in zip(*np.nonzero(np.abs(cosine - self.threshold) < 1e-9)):
            hit[i, j] = exact_cosine(self.x[rows[i]], self.y[columns[j]]) >= self.threshold
        own = hit.any(1)
        if not own.any():
            return
        rows, hit = rows[own], hit[own]
        self.count_x[rows] += hit @ self.wy[columns]
        if not within:
            self.count_y[columns] += self.wx[rows] @ hit
        # Edges with the same components as all hits: each row to its first partner; of the
        # other pairs one for each partner and set of rows joined by their first.
        first = hit.argmax(1)
        self.edges.append((rows, columns[first]))
        hit[np.arange(len(rows)), first] = False
        i, j = np.nonzero(hit)
        if len(i):
            pair = np.unique(first[i] * np.int64(len(columns)) + j, return_index=True)[1]
            self.edges.append((rows[i[pair]], columns[j[pair]]))

    def walk(self, p: Node, q: Node):
        if self.same:
            self._within(p)
        else:
            self._between([p], [q], False)

    def _within(self, p: Node):
        if 2 * p.radius <= self.reach - SLACK:
            self._all_within(p.points)
        elif p.children:
            for c in p.children:
                if len(c.points) > 1:
                    self._within(c)
            self._between(p.children, p.children, True)
        else:
            for a in range(0, len(p.points), 512):
                own = p.points[a:a + 512]
                cosine = self.x[own] @ self.x[p.points].T
                cosine[np.arange(len(own)), np.arange(a, a + len(own))] = -2
                self._hits(own, p.points, cosine, within=True)

    def _single(self, rows, columns, ordered):
        """Points against points: distances to centres are all there is to prune by."""
        for a in range(0, len(rows), 512):
            near = self.narrow_x[rows[a:a + 512]] @ self.narrow_y[columns].T
            i, j = np.nonzero(near >= self.threshold - NARROW)
            i += a
            if ordered:
                i, j = i[j > i], j[j > i]
            if len(i):
                own, at = np.unique(i, return_inverse=True)
                other, to = np.unique(j, return_inverse=True)
                cosine = np.full((len(own), len(other)), -2.0)
                cosine[at, to] = (self.x[rows[i]] * self.y[columns[j]]).sum(1)
                self._hits(rows[own], columns[other], cosine)

    def _between(self, ps, qs, ordered):
        """Meet two lists of nodes; those of one point apart from the others."""
        one_p, many_p = _by_size(ps)
        one_q, many_q = (one_p, many_p) if ordered else _by_size(qs)
        if one_p and one_q:
            self._single(np.array([p.points[0] for p in one_p]),
                         np.array([q.points[0] for q in one_q]), ordered)
        if many_p and many_q:
            self._nodes(many_p, many_q, ordered)
        if many_p and one_q:
            self._nodes(many_p, one_q, False)
        if one_p and many_q and not ordered:
            self._nodes(one_p, many_q, False)

    def _nodes(self, ps, qs, ordered):
        """Prune, count whole, compare leaves, go down elsewhere."""
        centre_q = np.array([q.points[0] for q in qs])
        radius_q = np.array([q.radius for q in qs])
        leaf_q = np.array([not q.children for q in qs])
        for a in range(0, len(ps), 512):
            own = ps[a:a + 512]
            gap = _distances(self.x[[p.points[0] for p in own]], self.y[centre_q])
            room = np.array([p.radius for p in own])[:, None] + radius_q
            open_ = gap - room <= self.reach + SLACK
            if ordered:
                open_ &= np.arange(len(qs)) > np.arange(a, a + len(own))[:, None]
            whole = open_ & (gap + room <= self.reach - SLACK)
            for k, l in zip(*np.nonzero(whole)):
                self._all(own[k].points, qs[l].points)
            open_ &= ~whole
            leaf_p = np.array([not p.children for p in own])
            for k in np.flatnonzero(~leaf_p & open_.any(1)):
                self._between(own[k].children, [qs[l] for l in np.flatnonzero(open_[k])], False)
            open_ &= leaf_p[:, None]
            for l in np.flatnonzero(~leaf_q & open_.any(0)):
                self._between([own[k] for k in np.flatnonzero(open_[:, l])], qs[l].children, False)
            open_ &= leaf_q
            if open_.any():
                self._masked(own, qs, open_)


def _by_size(nodes):
    return [n for n in nodes if len(n.points) == 1], [n for n in nodes if len(n.points) > 1]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)))


def block_links(x, y, weight_x, weight_y, threshold, same) -> Links:
    found = Links(x, y, weight_x, weight_y, threshold, same)
    if len(x) and len(y):
        root = build(x)
        found.walk(root, root if same else build(y))
    return found


# ---- the jobs -------------------------------------------------------------------------

def usable(vector: str) -> "F.Column":
    """Vectors that are not null, not zero and hold finite numbers only."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0)
                      & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e)
                                 & (F.abs(e) < F.lit(float("inf"))))
                      & F.exists(v, lambda e: e != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if len(m) else m


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                    threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Null vectors, empty or zero ones, and those with null or non-finite components link with
    nothing and are their own component. Vectors of different lengths are never compared.
    Repeated vectors, repeated rows included, are links of each other; a null id has links but
    names no component unless it stands alone (null). An empty table gives an empty result;
    other columns are ignored. ``threshold`` must be over 0.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(vec_id).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    keyed = named.withColumn("ok", usable("v")).withColumn(
        "k", F.when(F.col("ok"), F.struct(
            F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    members = materialise(keyed.select("i", "k", "ok"), "vector-keys")
    classes = materialise(
        keyed.filter("ok").groupBy("k").agg(
            F.count(F.lit(1)).alias("n"), F.min("i").alias("i"), F.first("v").alias("v"))
        .withColumn("c", F.xxhash64("k")), "vector-classes")

    # Cells around pivots: a bounded sample of the classes of each vector length.
    sizes = {r["d"]: r["count"] for r in
             classes.groupBy(F.size("v").alias("d")).count().collect()}
    found = []
    for width, total in sorted(sizes.items()):
        own = classes.filter(F.size("v") == width)
        want = min(MAX_PIVOTS, -(-total // block_rows))
        pivots = own.filter(uniform("c") < min(1.0, (2 * want + 30) / total)).orderBy("c").limit(want)
        found.append(_cell_links(spark, own, _unit(np.array(
            [r["v"] for r in pivots.collect()] or [[1.0] + [0.0] * (width - 1)], np.float64)),
            threshold, block_rows))
    empty = spark.createDataFrame([], "kind string, a long, b long, n long")
    for part in found:
        empty = empty.unionByName(part)
    results = materialise(empty, "vector-links")
    counts = results.filter("kind = 'count'").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(results.filter("kind = 'edge'"))
    # Components are found over class numbers; their names are the smallest ids in them.
    named = classes.select("c", "k", "n", "i").join(counts, F.col("c") == F.col("a"), "left").join(
        roots, F.col("c") == F.col("id"), "left").select(
        "k", "i", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "c").alias("root"))
    smallest = named.groupBy("root").agg(F.min("i").alias("component_id"))
    named = materialise(named.join(smallest, "root").select("k", "n_links", "component_id"),
                        "vector-results")
    return members.join(broadcast_if_small(named), "k", "left").select(
        F.col("i").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("i")).alias("component_id"),
    ).withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))


def _cell_links(spark, classes: DataFrame, pivots: np.ndarray, threshold: float,
                block_rows: int) -> DataFrame:
    """(kind, a, b, n): counts of links by class, and edges that span them."""
    def assign(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(2)))
            gap = _distances(x, pivots)
            home = gap.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.array(home, pa.int32()), pa.array(gap[np.arange(len(x)), home])],
                names=["c", "n", "v", "cell", "gap"])

    placed = materialise(classes.select("c", "n", "v").mapInArrow(
        assign, "c long, n long, v array<double>, cell int, gap double"), "vector-cells")
    cells = placed.groupBy("cell").agg(
        F.max("gap").alias("r"), F.count(F.lit(1)).alias("m")).collect()  # bounded by MAX_PIVOTS
    reach = math.sqrt(2 - 2 * threshold)
    between = _distances(pivots, pivots)
    blocks = {c["cell"]: -(-c["m"] // block_rows) for c in cells}
    near = [(c["cell"], blocks[c["cell"]], o["cell"], blocks[o["cell"]])
            for c in cells for o in cells
            if between[c["cell"], o["cell"]] <= c["r"] + o["r"] + reach + SLACK]
    table = spark.createDataFrame(
        near, "cell int, own_blocks int, other int, other_blocks int")
    # A vector goes to one task per block it must meet; a task is a pair of blocks.
    spread = placed.join(F.broadcast(table), "cell").withColumn(
        "own", F.pmod(F.xxhash64("c", F.lit("block")), F.col("own_blocks")).cast("int")).withColumn(
        "against", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    me, it = F.struct("cell", F.col("own").alias("block")), F.struct(
        F.col("other").alias("cell"), F.col("against").alias("block"))
    spread = spread.select(
        "c", "n", "v", F.least(me, it).alias("p"), F.greatest(me, it).alias("q"),
        (me <= it).alias("left"))

    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("a", T.LongType()),
                         T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])

    def compare(key, group):
        same = key[0].as_py() == key[1].as_py()
        left = group["left"].to_numpy()
        c, n = group["c"].to_numpy(), group["n"].to_numpy()
        x = _unit(_matrix(group["v"]))
        order = np.argsort(c, kind="stable")  # the same trees in every attempt
        p, q = order[left[order]], order[~left[order]]
        if same:
            q = p
        links = block_links(x[p], x[q], n[p], n[q], threshold, same)
        a, b, amount, kinds = [], [], [], []
        for count, at in ((links.count_x, p), *([] if same else [(links.count_y, q)])):
            some = np.flatnonzero(count)
            a.append(c[at[some]])
            b.append(c[at[some]])
            amount.append(count[some])
            kinds += ["count"] * len(some)
        if links.edges:
            e = np.concatenate([np.stack((c[p[s]], c[q[t]]), 1) for s, t in links.edges])
            e = np.unique(e[e[:, 0] != e[:, 1]], axis=0)
            a.append(e[:, 0])
            b.append(e[:, 1])
            amount.append(np.zeros(len(e), np.int64))
            kinds += ["edge"] * len(e)
        return pa.table({"kind": pa.array(kinds, pa.string()),
                         "a": np.concatenate(a).astype(np.int64),
                         "b": np.concatenate(b).astype(np.int64),
                         "n": np.concatenate(amount).astype(np.int64)})

    return spread.groupBy("p", "q").applyInArrow(compare, kind)
