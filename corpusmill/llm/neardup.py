"""Documents joined by Jaccard similarity of their word 5-grams (operator 4).

Method: MinHash LSH forest. Every document's signature is a label in each of ``TREES`` prefix
tries; documents that share a prefix are candidates. The search starts with the longest prefix
and shortens it. At each depth the pairs that meet there for the first time are verified
exactly, and the recall is estimated from the verified links (a link of similarity J is met at
depth k with probability 1-(1-J^k)^TREES); it stops at the target recall, or at the depth at
which even a pair at the threshold itself is met with the target probability.

Documents with the same shingle set are one class, represented by the smallest id; only
representatives are compared. Sorted runs of equal prefixes are the tries' subtrees: a task
walks them in order. Runs over ``RUN_ROWS`` are cut into blocks, one task run per pair of
blocks, so a prefix shared by a third of all documents is spread. A pair is taken up in the
first trie it meets in, hence counted once; texts travel only to runs that verify something;
counts and spanning edges leave a task, pairs never do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.words import mixed, slices, strings, word_codes, word_hashes
from corpusmill.operators.lookup import fetch, without
from corpusmill.storage import broadcast_if_small, materialise

WORDS = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 6
RECALL = 0.9999
RUN_ROWS = 1024
J_BINS = 200


# ---- shingles and signatures ----------------------------------------------------------

def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text: hashes of ``words`` words in a row; a
    shorter text is one shingle of all its words; a text without words has none."""
    offsets, codes, vocab = word_codes(texts)
    word = word_hashes(vocab)[codes]
    rolled = np.zeros(len(word), np.uint64)
    for k in range(words):
        if len(word) > k:
            step = rolled[:len(word) - k]
            step *= np.uint64(0x9E3779B97F4A7C15)
            step += word[k:]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + w
            out.append(mixed(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250101)
    return ((rng.integers(0, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32),
            rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))


def labels(sets: list[np.ndarray], trees: int = TREES, depth: int = MAX_DEPTH) -> list[bytes]:
    """Tree labels of each set, laid end to end: ``depth`` 16-bit minima per tree."""
    a, b = _multipliers(trees * depth)
    out = []
    for s in sets:
        low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        least = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(low), 4096):
            least = np.minimum(least, (low[None, k:k + 4096] * a[:, None] + b[:, None]).min(1))
        least ^= least >> np.uint32(16)
        least *= np.uint32(0x85EBCA6B)
        out.append((least >> np.uint32(16)).astype("<u2").tobytes())
    return out


def met(j, depth: int, trees: int = TREES):
    """Probability that a pair of similarity j shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - j ** depth) ** trees


def _key(s: np.ndarray, salt: int) -> int:
    """64 bits of a whole set, whatever its order."""
    return int(mixed(s ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64))


def sketch(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(i, k1, k2, n, labels): a 128-bit key of the shingle set, its size, its tree labels."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in slices(texts):
                sets = shingles(texts.slice(a, b - a))
                k1 = [_key(s, 0) for s in sets]
                k2 = [_key(s, 0xA5A5A5A5A5A5A5A5) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(k1, pa.int64()),
                     pa.array(k2, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(labels(sets), pa.binary())],
                    names=["i", "k1", "k2", "n", "labels"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(
        run, f"i {kind}, k1 long, k2 long, n long, labels binary")


# ---- runs of equal prefixes, inside a task --------------------------------------------

def _runs(batches, keys: list[str]):
    """Tables of whole runs of rows with equal keys, from batches sorted by them. A run is
    bounded, since large ones have been cut into blocks."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        mark = np.stack([table[k].to_numpy() for k in keys], 1)
        starts = np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1
        if held and tuple(mark[0]) != last:
            yield _whole(held, keys)
            held = []
        if len(starts):
            held.append(table.slice(0, starts[-1]))
            yield _whole(held, keys)
            held = [table.slice(starts[-1])]
        else:
            held.append(table)
        last = tuple(mark[-1])
    if held:
        yield _whole(held, keys)


def _whole(tables, keys):
    table = pa.concat_tables(tables).combine_chunks()
    mark = np.stack([table[k].to_numpy() for k in keys], 1)
    bounds = np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1
    return table, np.concatenate(([0], bounds, [len(mark)]))


def _new_pairs(label: np.ndarray, size: np.ndarray, side: np.ndarray, cross: bool, tree: int,
               depth: int, before: int | None, threshold: float):
    """Index pairs of a run that are candidates here: sizes allow the threshold, they meet in
    this tree first, and met in no tree at the depth searched before."""
    n = len(label)
    if cross:
        rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    else:
        rows = columns = np.arange(n)
    out = []
    for a in range(0, len(rows), 256):
        own = rows[a:a + 256]
        low = np.minimum(size[own][:, None], size[columns][None])
        high = np.maximum(size[own][:, None], size[columns][None])
        ok = low >= threshold * high
        if not cross:
            ok &= columns[None] > own[:, None]
        i, j = np.nonzero(ok)
        i, j = own[i], columns[j]
        for t in range(label.shape[1]):
            if not len(i):
                break
            if t < tree:
                same = (label[i, t, :depth] == label[j, t, :depth]).all(1)
            elif before is not None:
                same = (label[i, t, :before] == label[j, t, :before]).all(1)
            else:
                break
            i, j = i[~same], j[~same]
        out.append((i, j))
    return (np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)]),
            np.concatenate([y for _, y in out] or [np.zeros(0, np.int64)]))


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, by position in ``sets``."""
    used, places = np.unique(np.concatenate((i, j)), return_inverse=True)
    sets, i, j = [sets[k] for k in used], places[:len(i)], places[len(i):]
    if len(i) <= 2 * len(sets):
        return np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size
                         for a, b in zip(i, j)], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (a, a + 4096))
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        total += block @ block.T  # whole numbers far below 2^24
    return total[i, j].astype(np.int64)


# ---- the jobs -------------------------------------------------------------------------

def _search(spark, reps: DataFrame, texts: DataFrame, depth: int, before: int | None,
            threshold: float) -> DataFrame:
    """Links first met at this depth, as rows (kind, a, b, n): ``count`` n links of class a,
    ``edge`` between classes a and b, ``bin`` n links of similarity a/J_BINS."""
    # Prefixes that more than one representative shares, with the number of their blocks; only
    # numbers are moved to find them, labels follow for the documents that are left.
    trees = reps.select("c", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"),
                        "labels").withColumn(
        "prefix", F.xxhash64("tree", F.substring(
            F.col("labels"), F.col("tree") * (2 * MAX_DEPTH) + 1, F.lit(2 * depth)))).drop("labels")
    shared = trees.groupBy("prefix").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(
        "prefix", F.ceil(F.col("m") / RUN_ROWS).cast("int").alias("blocks"))
    members = trees.join(shared, "prefix").join(reps.select("c", "n", "labels"), "c").withColumn(
        "own", F.pmod(F.xxhash64("c", "tree"), F.col("blocks")).cast("int"))
    members = members.withColumn("against", F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "prefix", "tree", F.least("own", "against").alias("p"),
        F.greatest("own", "against").alias("q"),
        (F.col("own") > F.col("against")).cast("int").alias("side"), "c", "n", "labels")
    keys = ["prefix", "p", "q"]
    members = members.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "c")

    def choose(batches):
        for table, bounds in _runs(batches, keys):
            label = _label_matrix(table["labels"])
            size, side, tree, p, q = (
                table[c].to_numpy() for c in ("n", "side", "tree", "p", "q"))
            needed = np.zeros(table.num_rows, bool)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a > 1:
                    i, j = _new_pairs(label[a:b], size[a:b], side[a:b], p[a] != q[a],
                                      int(tree[a]), depth, before, threshold)
                    needed[a + i] = True
                    needed[a + j] = True
            if needed.any():
                yield from table.select([*keys, "side", "tree", "c"]).filter(
                    pa.array(needed)).to_batches()

    needed = materialise(members.mapInArrow(
        choose, "prefix long, p int, q int, side int, tree int, c long"), "needed")
    wanted = materialise(needed.select("c").distinct().join(
        reps.select("c", "r", "k1", "weight", "labels"), "c"), "wanted")
    # ids alone may be broadcast; labels, far larger, meet their rows in a shuffle
    bodies = fetch(texts, wanted.select("c", "r"), "r")
    placed = needed.join(wanted.drop("r"), "c").join(bodies, "c").select(
        *keys, "side", "tree", "c", "k1", "weight", "labels", "text").repartition(
        *[F.col(k) for k in keys]).sortWithinPartitions(*keys, "c")

    def verify(batches):
        for table, bounds in _runs(batches, keys):
            sets, column = [], strings(table["text"])
            for x, y in slices(column):
                sets += shingles(column.slice(x, y - x))
            # An id may stand for several texts, or repeat: the key tells the one that is meant.
            k1, c = table["k1"].to_numpy(), table["c"].to_numpy()
            own = np.array([_key(s, 0) == k for s, k in zip(sets, k1.tolist())], bool)
            size = np.array([len(s) for s in sets])
            label = _label_matrix(table["labels"])
            weight, side, tree, p, q = (
                table[x].to_numpy() for x in ("weight", "side", "tree", "p", "q"))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                at = np.arange(a, b)[own[a:b]]
                at = at[np.unique(c[at], return_index=True)[1]]
                if len(at) < 2:
                    continue
                i, j = _new_pairs(label[at], size[at], side[at], p[a] != q[a], int(tree[a]),
                                  depth, before, threshold)
                i, j = at[i], at[j]
                both = overlaps(sets, i, j)
                either = size[i] + size[j] - both
                hit = both >= threshold * either - 1e-9
                i, j, similarity = i[hit], j[hit], both[hit] / either[hit]
                if not len(i):
                    continue
                counts = {}
                for x, y in ((i, j), (j, i)):
                    total = np.bincount(x - a, weight[y], b - a)
                    for k in np.flatnonzero(total):
                        counts[int(c[a + k])] = counts.get(int(c[a + k]), 0) + int(total[k])
                x, y = _spanning(c[i], c[j])
                bins, many = np.unique(np.floor(similarity * J_BINS).astype(np.int64),
                                       return_counts=True)
                first = np.concatenate((list(counts), x, bins)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["count"] * len(counts) + ["edge"] * len(x) + ["bin"] * len(bins)),
                     pa.array(first),
                     pa.array(np.concatenate((list(counts), y, bins)).astype(np.int64)),
                     pa.array(np.concatenate((list(counts.values()), np.zeros(len(x)), many))
                              .astype(np.int64))],
                    names=["kind", "a", "b", "n"])

    return materialise(placed.mapInArrow(verify, "kind string, a long, b long, n long"), "links")


def _label_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, TREES, MAX_DEPTH)


def _spanning(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of ids."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[b] = a
            keep.append(k)
    return i[keep], j[keep]


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 threshold: float = THRESHOLD, target_recall: float = RECALL) -> DataFrame:
    """One row per document: id, class_id, n_links, kept.

    A link is a pair of documents whose sets of word 5-grams (lower-cased runs of letters, marks
    and digits) have Jaccard similarity of ``threshold`` or more; ``n_links`` counts a
    document's links, copies included; ``class_id`` is the smallest id reachable by links;
    ``kept`` marks it. A text of fewer than five words is one shingle of all of them. Null,
    empty and wordless texts link with nothing and are their own class. A null id takes no part:
    its class is null, it has no links and is kept. Rows that share id and shingles are one
    document; where they share the id alone, each row has the links of its own text.
    Ids are whole numbers. An empty table gives an empty result; other columns are ignored.
    """
    return _joined(docs, doc_id, text, threshold, target_recall).drop("n")


def _joined(docs: DataFrame, doc_id: str, text: str, threshold: float,
            target_recall: float) -> DataFrame:
    """The result of ``jaccard_join`` and the number of shingles, n."""
    kind = docs.schema[doc_id].dataType
    marked = materialise(sketch(docs, doc_id, text), "sketches")
    rows = marked.filter("i is not null and n > 0")
    copies = rows.groupBy("k1", "k2", "i").agg(F.first("n").alias("n"),
                                               F.first("labels").alias("labels"))
    reps = materialise(copies.groupBy("k1", "k2").agg(
        F.min(F.col("i").cast("long")).alias("r"), F.count(F.lit(1)).alias("weight"),
        F.first("n").alias("n"), F.first("labels").alias("labels")).withColumn(
        "c", F.xxhash64("k1", "k2")), "representatives")
    texts = docs.select(F.col(doc_id).cast("long").alias("r"), F.col(text).alias("text"))

    links, before = None, None
    for depth in range(MAX_DEPTH, 0, -1):
        found = _search(docs.sparkSession, reps, texts, depth, before, threshold)
        links, before = found if links is None else links.unionByName(found), depth
        seen = {r["a"]: r["n"] for r in links.filter("kind = 'bin'").groupBy("a").agg(
            F.sum("n").alias("n")).collect()}  # at most J_BINS rows
        expected = sum(n / met(max(threshold, k / J_BINS), depth) for k, n in seen.items())
        enough = seen and sum(seen.values()) >= target_recall * expected
        if met(threshold, depth) >= target_recall or (enough and met(threshold, depth) >= 0.98):
            break

    counts = links.filter("kind = 'count'").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(links.filter("kind = 'edge'"))
    named = reps.select("c", "k1", "k2", "r", "weight").join(
        counts, F.col("c") == F.col("a"), "left").join(
        roots, F.col("c") == F.col("id"), "left").select(
        "k1", "k2", "r", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "c").alias("root"))
    smallest = named.groupBy("root").agg(F.min("r").alias("class_id"))
    named = materialise(named.join(smallest, "root").select("k1", "k2", "n_links", "class_id"),
                        "classes")
    compared = F.col("i").isNotNull() & (F.col("n") > 0)
    return marked.select("i", "k1", "k2", "n").join(
        named, ["k1", "k2"], "left").select(
        F.col("i").alias(doc_id),
        F.when(compared, F.col("class_id").cast(kind)).otherwise(F.col("i")).alias("class_id"),
        F.when(compared, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), "n",
    ).withColumn("kept", F.col(doc_id).eqNullSafe(F.col("class_id")))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they were, one row of each class: that of the smallest id.

    A row is known by id and text, so ids may be null or shared by different texts; a null id
    comes last. Of rows repeated with id and text one stays. Rows without words all stay.
    """
    row = F.xxhash64(F.col(doc_id), F.col(text))
    marks = _joined(docs.select(row.alias("__row"), text), "__row", text, threshold, RECALL)
    members = marks.filter("n > 0").groupBy("__row", "class_id").agg(F.count(F.lit(1)).alias("m"))
    ids = docs.groupBy(row.alias("__row")).agg(F.min(doc_id).alias("i"))
    members = materialise(members.join(ids, "__row"), "members")
    first = materialise(members.groupBy("class_id").agg(
        F.min(F.struct(F.col("i").isNull(), "i", "__row", "m")).alias("f")).select(
        "f.__row", "f.m"), "first-members")
    gone = members.select("__row").join(first, "__row", "left_anti").distinct()
    kept = without(docs.withColumn("__row", row), materialise(gone, "duplicates"), ["__row"])
    twice = materialise(first.filter("m > 1").select("__row").distinct(), "repeated-rows")
    if not twice.isEmpty():
        again = kept.join(broadcast_if_small(twice), "__row", "left_semi")
        kept = without(kept, twice, ["__row"]).unionByName(again.dropDuplicates([doc_id, text]))
    return kept.select(*docs.columns)
