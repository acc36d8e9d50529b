"""Hard negatives by rotated one-bit codes and certain bounds on inner products (operator 13).

Vectors become integers, so every score is exact and ties are ties. Each one is stored with its
codes: it is rotated, and the signs of its coordinates are a code ``c`` of unit length. The
alignment ``a = <v, c>`` is stored beside the code, and what it leaves, ``v - a c``, is coded again in
the same way, ``CODES`` times; the length of the last residual ``r`` is stored too. An anchor ``q`` is cut
to ``LEVELS`` levels a coordinate, ``q = q' + e``, as bit planes, so that ``<q', c>`` is a matter of
counting bits. Then, with nothing left to chance,

    <q, v> = sum of a <q', c>  +  <q', r>  +  <e, v>,

where Cauchy-Schwarz bounds the last two: ``|r|`` times the part of ``q'`` across the last code, and
``|e| |v|``. Rows whose interval cannot reach what is asked for are passed over; those
whose interval survives are scored with integers.

Rows are dealt to blocks and anchors to groups; a task compares one group with one block, so no
task grows with the table. The anchors are a fixed share of the rows, so the comparisons grow with its
square; only bit counts meet every pair. A block answers with its best few per anchor.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.storage import materialise

SCALE = 256
CODES = 4
LEVELS = 32  # of a cut coordinate; bit planes are its base-2 logarithm
POSITIVES = 5
NEGATIVES = 5
BLOCK_VALUES = 3_200_000  # components of a block of rows, about
GROUP_VALUES = 640_000  # and of a group of anchors
TILE = 1 << 20  # pairs that are estimated together
LARGEST = 1 << 24  # of a component's magnitude; scores of up to 2 ** 15 components fit 64 bits
NO_ID = (1 << 63) - 1

# the functions below travel with the task: executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rotation(size: int) -> np.ndarray:
    """An orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _rotated(vectors: np.ndarray) -> np.ndarray:
    """Padded to whole 64-bit words of coordinates, then rotated."""
    size = -(-vectors.shape[1] // 64) * 64
    padded = np.zeros((len(vectors), size))
    padded[:, :vectors.shape[1]] = vectors
    return padded @ rotation(size)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, length of the last residual) of integer vectors; codes are rows of
    CODES times 64-bit words."""
    rest = _rotated(vectors)
    size = rest.shape[1]
    words, along = [], []
    for _ in range(CODES):
        up = rest >= 0
        code = np.where(up, 1.0, -1.0) / np.sqrt(size)
        a = (rest * code).sum(1)
        rest = rest - a[:, None] * code
        words.append(np.packbits(up, axis=1).view(np.uint64))
        along.append(a)
    return np.concatenate(words, 1), np.stack(along, 1), np.sqrt((rest * rest).sum(1))


class Anchors:
    """Anchors cut to levels, as bit planes."""

    def __init__(self, vectors: np.ndarray):
        turned = _rotated(vectors)
        self.size = turned.shape[1]
        low, high = turned.min(1), turned.max(1)
        self.step = np.maximum((high - low) / (LEVELS - 1), 1e-9)
        level = np.rint((turned - low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.low = low
        cut = low[:, None] + self.step[:, None] * level
        self.total = level.sum(1).astype(np.float64)
        self.square = (cut * cut).sum(1)
        self.missed = np.sqrt(((turned - cut) ** 2).sum(1))
        self.length = np.sqrt((turned * turned).sum(1))
        self.planes = [np.packbits(level >> k & 1, axis=1).view(np.uint64)
                       for k in range((LEVELS - 1).bit_length())]

    def bounds(self, some: slice, codes: np.ndarray, along: np.ndarray, rest: np.ndarray,
               length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, half width) of the inner products of some anchors with all rows."""
        words = self.size // 64
        step, low = self.step[some, None], self.low[some, None]
        estimate = 0.0
        for k in range(CODES):
            code = codes[:, k * words:(k + 1) * words]
            ones = np.bitwise_count(code).sum(1).astype(np.float64)
            met = 0.0
            for bit, plane in enumerate(self.planes):
                both = 0
                for w in range(words):
                    both = both + np.bitwise_count(plane[some, w, None] & code[None, :, w])
                met = met + both * float(1 << bit)
            # the code is +-1 / sqrt(size): twice what the ones see, less the whole
            inner = (2 * (low * ones + step * met) - (low * self.size + step * self.total[some, None])
                     ) / np.sqrt(self.size)
            estimate = estimate + inner * along[None, :, k]
        across = np.sqrt(np.maximum(self.square[some, None] - inner * inner, 0))
        half = across * rest + self.missed[some, None] * length
        return estimate, half + 1e-9 * (self.length[some, None] * length + 1)


def _best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n``: higher scores first, then smaller ids."""
    return np.lexsort((ids, -score))[:n]


def scan(rows: dict, anchors: dict, choose):
    """Call ``choose(anchor number, score of some rows, estimate, half width)`` for every anchor;
    ``score`` takes row places and gives exact inner products."""
    vectors = rows["vector"]
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    queries = Anchors(anchors["vector"])
    step = max(1, TILE // max(len(vectors), 1))
    for a in range(0, len(anchors["vector"]), step):
        some = slice(a, a + step)
        estimate, half = queries.bounds(some, rows["codes"], rows["along"], rows["rest"], length)
        for i in range(len(estimate)):
            q = anchors["vector"][a + i]
            yield from choose(a + i, lambda at, q=q: vectors[at] @ q, estimate[i], half[i])


def positives(rows: dict, anchors: dict):
    """(anchor, row, score): the best rows of the anchor's label in this block."""
    order = np.argsort(rows["label"], kind="stable")
    labels = rows["label"][order]

    def choose(a, score, estimate, half):
        label = anchors["label"][a]
        at = order[np.searchsorted(labels, label):np.searchsorted(labels, label, "right")]
        at = at[rows["row"][at] != anchors["row"][a]]
        if not len(at):
            return
        first = at[np.argsort(-estimate[at], kind="stable")[:POSITIVES]]
        floor = score(first).min() if len(first) == POSITIVES else -np.inf
        at = at[estimate[at] + half[at] >= floor]
        found = score(at)
        for k in _best(found, rows["vec_id"][at], POSITIVES):
            yield a, at[k], found[k]

    yield from scan(rows, anchors, choose)


def negatives(rows: dict, anchors: dict):
    """(anchor, positive, row, score): the best rows of other labels in this block, of those that
    score at least 80 and at most 100 hundredths of the positive."""
    def choose(a, score, estimate, half):
        wanted = anchors["positives"][a]  # scores of the positives
        floor, top = -(-80 * min(wanted) // 100), max(wanted)
        other = rows["label"] != anchors["label"][a]
        at = np.flatnonzero(other & (estimate + half >= floor) & (estimate - half <= top))
        if not len(at) or floor > top:
            return
        # the likeliest rows, scored first, raise the floor of every window
        likely = at[np.argsort(-estimate[at], kind="stable")]
        under = np.searchsorted(-estimate[likely], [-p for p in wanted])
        first = likely[np.unique(np.concatenate(
            [np.arange(u, min(u + 3 * NEGATIVES, len(likely))) for u in under]))]
        seen = score(first)
        floors = []
        for p in wanted:
            inside = np.sort(seen[seen <= p])[::-1]
            floors.append(max(-(-80 * p // 100),
                              inside[NEGATIVES - 1] if len(inside) >= NEGATIVES else floor))
        reach = np.zeros(len(at), bool)
        upper, lower = estimate[at] + half[at], estimate[at] - half[at]
        for p, low in zip(wanted, floors):
            reach |= (upper >= low) & (lower <= p)
        at = at[reach]
        found = score(at)
        for k, p in enumerate(wanted):
            inside = np.flatnonzero((found >= -(-80 * p // 100)) & (found <= p))
            for j in inside[_best(found[inside], rows["vec_id"][at[inside]], NEGATIVES)]:
                yield a, k, at[j], found[j]

    yield from scan(rows, anchors, choose)


# ---- as Spark jobs ---------------------------------------------------------------------------

PREPARED = "row long, vec_id long, label long, size int, vector binary, codes binary, " \
           "along binary, rest double"


def prepare(embeddings: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """The rows that take part, as integers, with their codes."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double") * SCALE) < LARGEST))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.col(vector).alias("_v"))
    rows = rows.withColumnRenamed("_v", vector).filter(
        F.col("label").isNotNull() & F.col(vector).isNotNull() & finite).select(
        "row", "vec_id", "label", F.size(vector).alias("size"), whole.alias("v"))

    def run(batches):
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                v = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                v = v.reshape(part.num_rows, size)
                codes, along, rest = encode(v)
                raw = (v.astype("<i4"), codes, along)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4]] + [pa.array([x.tobytes() for x in r], pa.binary())
                                           for r in raw] + [pa.array(rest)],
                    names=[c.split()[0] for c in PREPARED.split(", ")])

    return rows.filter("size > 0").mapInArrow(run, PREPARED)


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _columns(table: pa.Table, size: int) -> dict:
    words = -(-size // 64)
    out = {c: table[c].to_numpy() for c in ("row", "label")}
    out["vec_id"] = np.array([NO_ID if x is None else x for x in table["vec_id"].to_pylist()], np.int64)
    out["vector"] = _matrix(table["vector"], "<i4", size).astype(np.int64)
    if "codes" in table.column_names:
        out["codes"] = _matrix(table["codes"], np.uint64, CODES * words)
        out["along"] = _matrix(table["along"], np.float64, CODES)
        out["rest"] = table["rest"].to_numpy()
    return out


def _compared(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, function,
              schema: str) -> DataFrame:
    """``function`` over every group of anchors and every block of rows of the same size."""
    def dealt(n):
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.withColumn("block", dealt(blocks)).withColumn("group", each(groups))
    right = anchors.withColumn("group", dealt(groups)).withColumn("block", each(blocks))
    keys = ["size", "block", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(function, schema)


def _first(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each anchor's (or window's) answers from all blocks."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
         label: str = "label", anchor_every: int = 100, relabel_every: int = 7) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label or vector, or with null or non-finite components, take no part; nor do
    empty vectors and those with a component of 65,536 or more, whose scores 64 bits need not hold.
    Zero vectors score 0. Vectors of different sizes are not compared. Rows without an id are
    no anchors, and come last among equal scores. Repeated rows are rows of their own: each is an
    anchor if its id says so, and a candidate for the others. Ids and labels are whole numbers.
    Anchors without a positive, or without a negative in reach, give no rows. An empty table gives
    none. Other columns are not looked at.
    """
    spark = embeddings.sparkSession
    own = F.col(label)
    mixed = F.when(F.col(vec_id).cast("long") % relabel_every == 0, (own + 1) % 10).otherwise(own)
    rows = materialise(prepare(embeddings, vec_id, vector, mixed), "coded-vectors")
    chosen = F.col("vec_id") % anchor_every == 0
    anchors = rows.filter(chosen)
    n, values, asking = rows.agg(F.count(F.lit(1)), F.sum("size"),
                                 F.sum(F.when(chosen, F.col("size")))).first()
    blocks = max((values or 0) // BLOCK_VALUES + 1,
                 min(spark.sparkContext.defaultParallelism, n // 500 + 1))
    groups = (asking or 0) // GROUP_VALUES + 1
    plain = anchors.select("row", "vec_id", "label", "size", "vector")

    def ids(table: pa.Table, at) -> pa.Array:
        return table["vec_id"].combine_chunks().take(pa.array(at, pa.int64()))

    def near(table: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and asked.num_rows:
            size = table["size"][0].as_py()
            r, a = _columns(table, size), _columns(asked, size)
            found = list(positives(r, a))
        a_, r_, s_ = map(list, zip(*found)) if found else ([], [], [])
        return pa.table({
            "anchor": asked["row"].combine_chunks().take(pa.array(a_, pa.int64())),
            "row": table["row"].combine_chunks().take(pa.array(r_, pa.int64())),
            "vec_id": ids(table, r_), "score": pa.array(s_, pa.int64())})

    close = _first(_compared(rows, plain, blocks, groups, near,
                             "anchor long, row long, vec_id long, score long"),
                   ["anchor"], POSITIVES)
    asked = materialise(close.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives")), "positives")
    wanted = materialise(plain.join(asked, plain["row"] == asked["anchor"]).drop("anchor"), "windows")

    def hard(table: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and asked.num_rows:
            size = table["size"][0].as_py()
            r, a = _columns(table, size), _columns(asked, size)
            a["positives"] = [[p["score"] for p in x] for x in asked["positives"].to_pylist()]
            found = list(negatives(r, a))
        a_, k_, r_, s_ = map(list, zip(*found)) if found else ([], [], [], [])
        return pa.table({
            "anchor": asked["row"].combine_chunks().take(pa.array(a_, pa.int64())),
            "positive": pa.array(k_, pa.int32()),
            "row": table["row"].combine_chunks().take(pa.array(r_, pa.int64())),
            "vec_id": ids(table, r_), "score": pa.array(s_, pa.int64())})

    found = _first(_compared(rows, wanted, blocks, groups, hard,
                             "anchor long, positive int, row long, vec_id long, score long"),
                   ["anchor", "positive"], NEGATIVES)
    positive = F.element_at("positives", F.col("positive") + 1)
    names = wanted.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "positives")
    return found.join(names, "anchor").select(
        "anchor_id", positive["id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
