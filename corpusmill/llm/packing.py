"""Best-fit packing of tokenised documents into sequences of bounded length (operator 3).

Method: bin completion. Take the largest piece left, enumerate the undominated fillings of the
room beside it (a filling no larger than one with fewer pieces is dominated), least waste
first, branch on them, and prune where the waste so far leaves no way to beat the incumbent,
which is best-fit decreasing at first. Lengths are whole numbers up to the capacity, so the
search runs on the *histogram* of lengths: at most ``capacity`` numbers whatever the corpus
size. A filling is used as often as its pieces last while many are left; the search proper,
with backtracking, packs the last ``tail`` pieces.

Spark does the rest: tasks tokenise and cut, number their own pieces by length, one narrow
aggregation turns these numbers into global ones, and every piece finds its place in the plan
by length and number. No task or driver sees the pieces themselves.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.tokens import SLICE_BYTES, default_path, encoder
from corpusmill.llm.words import slices, strings
from corpusmill.storage import broadcast_if_small, materialise

CAPACITY = 2048
NODE_LIMIT = 20_000
BRANCH = 24
TAIL = 60


# ---- the plan, on a histogram ---------------------------------------------------------

def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing with repeated patterns: [(pieces by length, times)]."""
    left, plan = {k: n for k, n in counts.items() if n}, []
    while left:
        room, used = capacity, Counter()
        for length in sorted(left, reverse=True):
            take = min(room // length, left[length])
            if take:
                used[length] += take
                room -= take * length
        times = min(left[k] // n for k, n in used.items())
        plan.append((dict(used), times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins needed at least: by total, and by what cannot stand beside large pieces."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for cut in {0, *(k for k in counts if k <= capacity // 2)}:
        alone = sum(n for k, n in counts.items() if k > capacity - cut)
        half = {k: n for k, n in counts.items() if capacity // 2 < k <= capacity - cut}
        small = sum(k * n for k, n in counts.items() if cut <= k <= capacity // 2)
        room = sum((capacity - k) * n for k, n in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(small - room) // capacity)))
    return best


def _sums(lengths: list[int], room: int) -> list[int]:
    """Bit sets of the sums of one, two and three lengths, up to ``room``."""
    mask, out = (1 << (room + 1)) - 1, []
    reach = 1
    for _ in range(3):
        step = 0
        for k in lengths:
            step |= reach << k
        reach = step & mask
        out.append(reach)
    return out


def _fillings(left: dict[int, int], room: int, branch: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first, fewer pieces first."""
    lengths = sorted((k for k in left if k <= room), reverse=True)
    if not lengths:
        return [()]
    found: dict[tuple[int, ...], None] = {}
    sums, best = _sums(lengths, room), 0

    def build(total: int, k: int, top: int, picked: tuple[int, ...]):
        if k == 0:
            yield picked
            return
        for x in lengths:
            if x > top or x * k < total or x > total or picked.count(x) >= left[x]:
                continue
            rest = total - x
            if (rest == 0 and k == 1) or (k > 1 and rest > 0 and sums[k - 2] >> rest & 1):
                yield from build(rest, k - 1, x, (*picked, x))

    for k, reach in enumerate(sums, 1):
        total, tried = room, 0
        while total > best and tried < 4:
            total = (reach & ((1 << (total + 1)) - 1)).bit_length() - 1
            if total <= best:
                break
            tried += 1
            got = [f for f, _ in zip(build(total, k, room, ()), range(max(1, branch // 6)))]
            for f in got:
                found[f] = None
            if got:
                best = max(best, total)
                break
            total -= 1
        if best == room:
            break
    stack = [(lengths, room, ())]  # then all others, largest pieces first
    while stack and len(found) < branch:
        options, space, picked = stack.pop()
        fits = [x for x in options if x <= space and picked.count(x) < left[x]]
        if not fits:
            found[tuple(sorted(picked, reverse=True))] = None
            continue
        for i in range(min(len(fits), branch) - 1, -1, -1):
            stack.append((fits[i:], space - fits[i], (*picked, fits[i])))
    full = []
    for f in found:  # fill what is left of a filling that is not maximal
        space, picked = room - sum(f), list(f)
        for x in lengths:
            while x <= space and picked.count(x) < left[x]:
                picked.append(x)
                space -= x
        full.append(tuple(sorted(picked, reverse=True)))
    full = sorted(set(full), key=lambda f: (room - sum(f), len(f), [-x for x in f]))
    kept, shortest = [], {}
    for f in full:  # dominated: one larger or equal piece stands for several
        if len(f) == 1 or not any(len(g) == 1 and g[0] >= sum(f) for g in kept):
            kept.append(f)
    return kept[:branch]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, node_limit: int = NODE_LIMIT,
              branch: int = BRANCH, tail: int = TAIL) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used; together they hold every piece exactly once.

    Optimal where the search of the last ``tail`` pieces ends within ``node_limit`` nodes and
    the fillings used in bulk waste nothing; never worse than best-fit decreasing.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    incumbent = best_fit(counts, capacity)
    bins = sum(n for _, n in incumbent)
    bound = lower_bound(counts, capacity)
    if bins == bound:
        return incumbent

    left, bulk, remaining = dict(counts), [], sum(counts.values())
    while left and remaining > tail:
        top = max(left)
        left[top] -= 1
        beside = _fillings({k: n for k, n in left.items() if n}, capacity - top, branch)[0]
        left[top] += 1
        used = Counter((top, *beside))
        times = min(left[k] // n for k, n in used.items())
        times = max(1, min(times, (remaining - tail) // sum(used.values())))
        bulk.append((dict(used), times))
        remaining -= times * sum(used.values())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    done = sum(n for _, n in bulk)
    rest = _search(left, capacity, node_limit, branch)
    if done + len(rest) < bins:
        return bulk + [(dict(Counter(f)), 1) for f in rest]
    return incumbent


def _search(left: dict[int, int], capacity: int, node_limit: int, branch: int):
    """Branch and bound over single bins; the best packing found as a list of fillings."""
    best = [f for used, n in best_fit(left, capacity) for f in [sorted(
        (k for k, c in used.items() for _ in range(c)), reverse=True)] * n]
    bound, total = lower_bound(left, capacity), sum(k * n for k, n in left.items())
    nodes = 0
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))

    def descend(left, path, waste):
        nonlocal best, nodes
        if not left:
            if len(path) < len(best):
                best = list(path)
            return
        nodes += 1
        if nodes > node_limit or len(best) == bound:
            return
        if len(path) + lower_bound(left, capacity) >= len(best):
            return
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
        for f in _fillings(rest, capacity - top, branch):
            lost = waste + capacity - top - sum(f)
            if total + lost > (len(best) - 1) * capacity:
                continue
            after = dict(rest)
            for x in f:
                after[x] -= 1
                if not after[x]:
                    del after[x]
            descend(after, [*path, [top, *f]], lost)

    descend(left, [], 0)
    return best


def place_table(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Where the pieces of a length go, by their number: from ``first`` on, ``copies`` per
    sequence, sequences from ``sequence``, the first of them at ``offset``."""
    rows, taken, sequence = [], Counter(), 0
    for used, times in plan:
        at = 0
        for length in sorted(used, reverse=True):
            rows.append((length, taken[length], used[length], sequence, at))
            taken[length] += used[length] * times
            at += length * used[length]
        sequence += times
    table = pd.DataFrame(rows, columns=["length", "first", "copies", "sequence", "offset"],
                         dtype="int64")
    return table.sort_values(["length", "first"]).reset_index(drop=True)


# ---- the jobs -------------------------------------------------------------------------

def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, append ``end_id``, cut what is longer than ``capacity``.

    The first piece of a cut document takes the remainder, the others are full. Null and empty
    texts are one piece holding the end id; repeated rows and null ids are pieces like any
    other; further columns are ignored. ``_part`` and ``_k`` number the pieces of one length
    within the task. ``with_ids`` adds the ids (little-endian 32-bit binary).
    """
    path = tokenizer or default_path("byte_bpe_50k.json")
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField(doc_id, kind), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("_part", T.IntegerType()),
        T.StructField("_k", T.LongType())]
        + [T.StructField("ids", T.BinaryType())] * with_ids)

    def cut(batches):
        encode, part = encoder(path, end_id, True).encode, TaskContext.get().partitionId()
        numbered = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in slices(texts, SLICE_BYTES):
                ids = encode(texts.slice(a, b - a))
                at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + b - a + 1]
                data = memoryview(ids.buffers()[2])
                n = np.diff(at) // 4
                many = -(-n // capacity)
                row = np.repeat(np.arange(b - a), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                head = (n - (many - 1) * capacity)[row]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                lo = at[row] + 4 * start
                cuts = [data[x:y] for x, y in zip(lo.tolist(), (lo + 4 * length).tolist())]
                k = pd.Series(length).groupby(length).cumcount().to_numpy() + numbered[length]
                numbered += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).slice(a, b - a).take(pa.array(row)),
                           pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                           pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                           pa.array(np.full(len(row), part), pa.int32()), pa.array(k)]
                if with_ids:
                    columns.append(pa.array([c.tobytes() for c in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY,
                   node_limit: int = NODE_LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece with its ``sequence_id`` and its ``offset`` there.

    An empty table gives an empty result. Equal lengths are told apart by an arbitrary but
    fixed numbering, so ties change which piece sits where, never the number of sequences.
    """
    cut = materialise(pieces(docs, doc_id, text, tokenizer, end_id, capacity, with_ids), "pieces")
    parts = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = materialise(parts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))),
                        "piece-counts")
    histogram = {r["length"]: r["n"] for r in
                 parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = place_table(plan_bins(histogram, capacity, node_limit))
    key = (table["length"].to_numpy() << 44) | table["first"].to_numpy()
    first, copies, sequence, offset = (
        table[c].to_numpy() for c in ("first", "copies", "sequence", "offset"))
    numbered = cut.join(broadcast_if_small(parts.drop("_n")), ["length", "_part"]).select(
        *cut.columns, (F.col("_first") + F.col("_k")).alias("_number"))
    names = [c for c in cut.columns if c not in ("_part", "_k")]
    schema = T.StructType([cut.schema[c] for c in names] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("_number").to_numpy()
            at = np.searchsorted(key, (length << 44) | number, "right") - 1
            r = number - first[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(sequence[at] + r // copies[at]),
                   pa.array(offset[at] + r % copies[at] * length)], names=schema.names)

    return numbered.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack_documents(with_ids=True)``: one row per
    ``sequence_id`` with its ids; a sequence holds at most ``capacity`` ids."""
    return packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"))
