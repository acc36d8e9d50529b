"""Repeated byte strings across documents, by sorting suffixes where they can repeat (operator 11).

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document of a smaller
id. Suffixes are only told apart on their first ``LENGTH`` bytes, so a suffix here is such a string.

1. Every string has an *anchor*: the leftmost of its ``GRAM``-byte grams with the least hash. It
   depends on the string's own bytes alone, so equal strings have equal anchors. Neighbouring strings
   with one anchor form a *segment*; a segment is moved as a whole, not string by string.
2. Documents are dealt to chunks of a few megabytes. A chunk sends its distinct anchors, in 32 bits
   besides the bucket, to buckets of about ``BUCKET_ANCHORS``, which answer with those that more than
   one document has.
3. The chunk sends each distinct segment of these anchors once, with its smallest document, to the
   anchor's bucket. There all suffixes are put into order: multikey quicksort to ``SHALLOW`` bytes,
   then blind tries. Equal neighbours get the least document among them, and this goes back.
4. The chunk marks the bytes of suffixes that a smaller document has, and removes them.

Texts equal to one of a smaller id take no part: all their strings also start there. Anchors that very many
documents have (the edges of a common line) are dealt by whole string instead of by anchor, so
no bucket holds them alone; a chunk sends a segment once however many of its documents have it. Texts
pass one shuffle, which all steps read. The plan has no driver step but one aggregate.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 50
GRAM = 16
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 20_000
BUCKET_ANCHORS = 1 << 18
HOT_SEGMENTS = 4096  # an anchor with so many is dealt by string; no result depends on it
SHALLOW = 16
SLICE = 1 << 21
LAST = (1 << 63) - 1  # stands for a missing id: such documents come after all others

SPREAD = 0x9E3779B97F4A7C15

# the functions below travel with the task: executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` (a power of two) bytes from each place on, by doubling."""
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, SPREAD
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = (factor * factor + 2) % (1 << 64)
        width *= 2
    return _mixed(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, hash of the anchor) of all segments of the documents laid end to end.

    Works through the bytes in slices; a segment cut by one becomes two.
    """
    sizes = np.diff(np.concatenate(([0], ends)))
    begins = ends - sizes
    found = []
    for a in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[a:a + SLICE + LENGTH - 1]
        h = gram_hashes(part, GRAM)
        ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        anchor = (_least(ranked, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # strings that lie in one document: of each document, all but the last LENGTH - 1 starts
        lo = np.clip(begins - a, 0, len(anchor))
        hi = np.clip(np.maximum(ends - LENGTH + 1, begins) - a, 0, len(anchor))
        change = np.zeros(len(anchor) + 1, np.int64)
        np.add.at(change, lo, 1)
        np.add.at(change, hi, -1)
        inside = np.cumsum(change[:-1]) > 0
        cut = np.ones(len(anchor), bool)
        cut[1:] = anchor[1:] != anchor[:-1]
        cut[lo[lo < len(anchor)]] = True
        cut[1:] |= inside[1:] != inside[:-1]
        starts = np.flatnonzero(cut)
        counts = np.diff(np.append(starts, len(anchor)))
        kept = inside[starts]
        starts, counts = starts[kept], counts[kept]
        found.append((starts + a, counts, h[anchor[starts]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def bucket_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, 32 other bits below."""
    g = _mixed(hashes ^ np.uint64(SPREAD))
    bucket = ((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return bucket << np.uint64(32) | (g & np.uint64(0xFFFFFFFF))


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the runs, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    flat = data[_ragged(starts, sizes)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes laid end to end, and each string's size."""
    at = np.frombuffer(strings.buffers()[1], np.int64)[
        strings.offset:strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)[at[0]:at[-1]], np.diff(at)


def string_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each of the LENGTH-byte strings laid end to end."""
    rows = np.zeros((len(data) // LENGTH, -(-LENGTH // 8) * 8), np.uint8)
    rows[:, :LENGTH] = data.reshape(-1, LENGTH)
    h = np.zeros(len(rows), np.uint64)
    for column in rows.view(np.uint64).T:
        h = _mixed(h * np.uint64(SPREAD) + column)
    return h


# ---- sorting suffixes ----------------------------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number in byte order."""
    out = np.zeros(len(data), np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    for k in range(8):
        out = out << np.uint64(8) | padded[k:k + len(data)]
    return out


def _first_difference(x: np.ndarray) -> np.ndarray:
    """Number of equal leading bytes of two words, from their exclusive or."""
    same = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        upper = (x >> np.uint64(64 - shift)) == 0
        same += np.where(upper, shift // 8, 0)
        x = np.where(upper, x << np.uint64(shift), x)
    return same + (x == 0)


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))


def _tied(group: np.ndarray) -> np.ndarray:
    """Members of groups of more than one; equal groups lie side by side."""
    same = group[1:] == group[:-1]
    return np.concatenate((same, [False])) | np.concatenate(([False], same))


def _shallow(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort on eight-byte characters: only ties of one are sorted by the next."""
    order, live = np.arange(len(at)), np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    for depth in range(0, SHALLOW, 8):
        key = words[at[order[live]] + depth]
        by = np.argsort(key) if depth == 0 else np.lexsort((key, group[live]))
        order[live] = order[live][by]
        key, old = key[by], group[live]  # groups are intervals: theirs stay where they were
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[_tied(group[live])]
        if not len(live):
            break
    return order, group


def _deep(data: np.ndarray, words: np.ndarray, at: np.ndarray, order: np.ndarray,
          group: np.ndarray) -> None:
    """Blind tries over the suffixes that are still tied, all groups at the same time.

    A node of a blind trie knows only how deep its suffixes agree and the byte in which they then
    part. That depth is the least agreement of any suffix with the node's first one; the
    suffixes are dealt to children by that one byte. A node whose suffixes never part is a leaf.
    """
    live = np.flatnonzero(_tied(group))
    depths = [*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8]
    while len(live):
        place = at[order[live]]
        first = _starts(group[live])
        size = np.diff(np.append(first, len(live)))
        leader = np.repeat(place[first], size)
        agreed = np.full(len(live), LENGTH, np.int64)
        for depth in reversed(depths):
            x = words[place + depth] ^ words[leader + depth]
            parted = x != 0
            agreed[parted] = depth + _first_difference(x[parted])
        node = np.minimum.reduceat(agreed, first)
        inner = np.repeat(node < LENGTH, size)
        live, place = live[inner], place[inner]
        if not len(live):
            return
        byte = data[place + np.repeat(node, size)[inner]]
        old = group[live]
        by = np.lexsort((byte, old))
        order[live] = order[live][by]
        byte = byte[by]
        new = np.ones(len(live), bool)
        new[1:] = (byte[1:] != byte[:-1]) | (old[1:] != old[:-1])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[_tied(group[live])]


def sort_suffixes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes at these places of ``data`` in order of their LENGTH bytes,
    and for each place of the order where its run of equal suffixes begins."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = _words(data)
    order, group = _shallow(words, at)
    _deep(data, words, at, order, group)
    return order, group


def least_documents(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix of LENGTH bytes of the segments laid end to end, the least document of
    a segment that has an equal one."""
    begins = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    order, group = sort_suffixes(data, _ragged(begins, counts))
    doc = np.repeat(docs, counts)
    if not len(order):
        return doc
    first = _starts(group)
    least = np.minimum.reduceat(doc[order], first)
    out = np.empty_like(doc)
    out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


# ---- chunks and buckets --------------------------------------------------------------------

class Chunk:
    """The texts of a chunk that take part, end to end, least document first."""

    def __init__(self, docs: pa.Table, notes: pa.Table, buckets: int):
        self.buckets = buckets
        rows = sorted(range(docs.num_rows), key=list(zip(
            docs["doc"].to_pylist(), docs["sha"].to_pylist())).__getitem__)
        self.docs = docs.take(pa.array(rows, pa.int64()))
        kind = notes["kind"].to_numpy()
        by_bucket = notes.take(pa.array(np.lexsort((notes["bucket"].to_numpy(), kind))))
        self.notes = {int(k): by_bucket.filter(pa.array(np.sort(kind) == k)) for k in set(kind)}
        least = dict(zip(*(self.notes[0][c].to_pylist() for c in ("data", "doc")))) \
            if 0 in self.notes else {}
        doc, sha = self.docs["doc"].to_numpy(), self.docs["sha"].to_pylist()
        self.copy = np.array([least.get(s, d) < d for s, d in zip(sha, doc.tolist())], bool)
        texts = self.docs["text"].combine_chunks().cast(pa.large_string()).cast(pa.large_binary())
        data, self.sizes = _bytes_of(texts)
        active = ~self.copy
        self.data = data[np.repeat(active, self.sizes)] if self.copy.any() else data
        self.ends = np.cumsum(self.sizes[active])
        self.doc = doc[active]
        self.start, self.count, hashes = segments(self.data, self.ends)
        self.of_doc = self.doc[np.searchsorted(self.ends, self.start, "right")] \
            if len(self.start) else np.zeros(0, np.int64)
        self.key = bucket_keys(hashes, buckets)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and how many documents have each."""
        order = np.argsort(self.key, kind="stable")  # documents of an anchor stay in order
        key, doc = self.key[order], self.of_doc[order]
        if not len(key):
            return key, np.zeros(0, np.int64)
        first = _starts(key)
        other = np.ones(len(key), bool)
        other[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return key[first], np.add.reduceat(other.astype(np.int64), first)

    def items(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct segments that other documents may have, by bucket.

        Returns their bytes, bucket and least document, and for each occurrence its start in the
        chunk and its segment.
        """
        flags = np.zeros(len(self.key), np.int8)
        if 1 in self.notes and len(self.key):
            known = np.unique(self.key)
            mark = np.zeros(len(known), np.int8)
            at = np.searchsorted(known >> np.uint64(32), np.arange(self.buckets + 1))
            for bucket, data in zip(self.notes[1]["bucket"].to_pylist(),
                                    self.notes[1]["data"].to_pylist()):
                mark[at[bucket]:at[bucket + 1]] = np.frombuffer(data, np.int8)
            flags = mark[np.searchsorted(known, self.key)]
        plain, hot = np.flatnonzero(flags == 1), np.flatnonzero(flags == 2)
        single = _ragged(self.start[hot], self.count[hot])  # hot segments, string by string
        start = np.concatenate((self.start[plain], single))
        size = np.concatenate((self.count[plain] + LENGTH - 1, np.full(len(single), LENGTH)))
        doc = np.concatenate((self.of_doc[plain], np.repeat(self.of_doc[hot], self.count[hot])))
        by_string = np.repeat([False, True], [len(plain), len(single)])
        order = np.argsort(start, kind="stable")  # so a segment's first one is of its least document
        start, size, doc, by_string = start[order], size[order], doc[order], by_string[order]
        coded = _strings(self.data, start, size).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        texts = coded.dictionary
        first = np.zeros(len(texts), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        bucket = np.zeros(len(texts), np.int64)
        whole = ~by_string[first]
        keys = self.key[np.searchsorted(self.start, start[first[whole]])]
        bucket[whole] = (keys >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(~whole)
        if len(cut):
            hashes = string_hashes(_bytes_of(texts.take(pa.array(cut)))[0])
            bucket[cut] = (bucket_keys(hashes, self.buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return (texts.take(pa.array(order)), bucket[order], doc[first][order], start, place[which])

    def covered(self) -> np.ndarray:
        """Which bytes a suffix covers that a smaller document has."""
        texts, _, _, start, which = self.items()
        strings = _bytes_of(texts)[1] - LENGTH + 1
        least = np.concatenate([np.frombuffer(pa.decompress(x, n, "zstd"), np.int64) for x, n in zip(
            self.notes[2]["data"].to_pylist(), self.notes[2]["doc"].to_pylist())]) \
            if 2 in self.notes else np.zeros(0, np.int64)
        change = np.zeros(len(self.data) + 1, np.int64)
        if len(which):
            of_item = _ragged((np.cumsum(strings) - strings)[which], strings[which])
            place = _ragged(start, strings[which])
            own = np.repeat(self.doc[np.searchsorted(self.ends, start, "right")], strings[which])
            hit = place[least[of_item] < own]
            np.add.at(change, hit, 1)
            np.add.at(change, hit + LENGTH, -1)
        return np.cumsum(change[:-1]) > 0


NOTES = "chunk int, kind int, bucket int, doc long, data binary"
_NOTES = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()),
                    ("doc", pa.int64()), ("data", pa.binary())])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _by_bucket(buckets: np.ndarray):
    """(bucket, from, to) of the runs of equal buckets."""
    first = _starts(buckets) if len(buckets) else np.zeros(0, np.int64)
    return zip(buckets[first].tolist(), first.tolist(), [*first[1:].tolist(), len(buckets)])


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 chunk_bytes: int = CHUNK_BYTES, bucket_anchors: int = BUCKET_ANCHORS,
                 hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; ``docs`` should be a table
    that reads alike each time.

    Null texts are empty. Rows without an id come after all others and lose nothing to each
    other; neither do rows that share an id. Texts shorter than LENGTH bytes lose nothing.
    Repeated rows are answered alike. Other columns are not looked at. An empty table gives
    an empty result. ``doc_id`` must be a whole number.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(body)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    chunks = (size["bytes"] or 0) // chunk_bytes + size["n"] // CHUNK_ROWS + 1
    # two anchors in LENGTH - GRAM + 2 bytes are expected
    buckets = 2 * (size["bytes"] or 0) // (LENGTH - GRAM + 2) // bucket_anchors + 1

    dealt = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(doc_id).alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"),
        F.unhex(F.sha2(body, 256)).alias("sha"), body.alias("text")).repartition("chunk")
    copies = (dealt.groupBy("sha", "chunk").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
              .withColumn("doc", F.min("low").over(Window.partitionBy("sha")))
              .filter("doc < high")
              .select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "doc",
                      F.col("sha").alias("data")))
    id_type = docs.schema[doc_id].dataType

    def send_anchors(texts: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(texts, notes, buckets)
        key, n = chunk.anchors()
        number = texts["chunk"][0].as_py() if texts.num_rows else 0
        values, few = key.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
        return _table(anchor_schema, [
            (number, b, values[i:j].tobytes(), few[i:j].tobytes())
            for b, i, j in _by_bucket((key >> np.uint64(32)).astype(np.int64))])

    anchor_schema = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()),
                               ("data", pa.binary()), ("n", pa.binary())])

    def flag_anchors(rows: pa.Table) -> pa.Table:
        values = [np.frombuffer(x, np.uint32) for x in rows["data"].to_pylist()]
        n = np.frombuffer(b"".join(rows["n"].to_pylist()), np.uint8).astype(np.int64)
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")
        first = _starts(every[order])
        total = np.add.reduceat(n[order], first)
        flag = np.where(total >= hot_segments, 2, np.where(total > 1, 1, 0)).astype(np.int8)
        flags = np.empty(len(every), np.int8)
        flags[order] = np.repeat(flag, np.diff(np.append(first, len(every))))
        out, at = [], 0
        for chunk, bucket, mine in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), values):
            here = flags[at:at + len(mine)]
            at += len(mine)
            if here.any():
                out.append((chunk, 1, bucket, 0, here.tobytes()))
        return _table(_NOTES, out)

    item_schema = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()),
                             ("size", pa.int64()), ("sizes", pa.binary()), ("data", pa.binary())])

    def send_segments(texts: pa.Table, notes: pa.Table) -> pa.Table:
        found, bucket, doc, _, _ = Chunk(texts, notes, buckets).items()
        number = texts["chunk"][0].as_py() if texts.num_rows else 0
        data, sizes = _bytes_of(found)
        at = np.concatenate(([0], np.cumsum(sizes)))
        sizes = sizes.astype(np.uint8)  # 2 * LENGTH - GRAM at most
        out = []
        for b, i, j in _by_bucket(bucket):
            raw = doc[i:j].tobytes() + data[at[i]:at[j]].tobytes()
            out.append((number, b, j - i, len(raw), sizes[i:j].tobytes(),
                        pa.compress(raw, "zstd", asbytes=True)))
        return _table(item_schema, out)

    def settle(rows: pa.Table) -> pa.Table:
        docs_, data, sizes, cuts = [], [], [], [0]
        for n, size_, s, raw in zip(*(rows[c].to_pylist() for c in ("n", "size", "sizes", "data"))):
            raw = pa.decompress(raw, size_, "zstd", asbytes=True)
            docs_.append(np.frombuffer(raw, np.int64, n))
            data.append(np.frombuffer(raw, np.uint8, offset=8 * n))
            sizes.append(np.frombuffer(s, np.uint8).astype(np.int64))
            cuts.append(cuts[-1] + int(sizes[-1].sum()) - n * (LENGTH - 1))
        least = least_documents(np.concatenate(data), np.concatenate(sizes), np.concatenate(docs_))
        out = []
        for k, (chunk, bucket) in enumerate(zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist())):
            raw = least[cuts[k]:cuts[k + 1]].tobytes()
            out.append((chunk, 2, bucket, len(raw), pa.compress(raw, "zstd", asbytes=True)))
        return _table(_NOTES, out)

    schema = T.StructType([
        T.StructField(doc_id, id_type), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType())])

    def remove(texts: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = Chunk(texts, notes, buckets)
        gone = chunk.covered()
        sizes = chunk.sizes
        removed = np.where(sizes >= LENGTH, sizes, 0)
        spans = (removed > 0).astype(np.int64)
        removed[~chunk.copy] = spans[~chunk.copy] = 0
        kept = [b""] * len(sizes)
        texts_ = chunk.docs["text"]
        for i in np.flatnonzero(chunk.copy & (sizes < LENGTH)):
            kept[i] = texts_[i].as_py().encode()
        begin = 0
        for i, end in zip(np.flatnonzero(~chunk.copy), chunk.ends.tolist()):
            mine, data = gone[begin:end], chunk.data[begin:end]
            if mine.any():
                removed[i] = mine.sum()
                spans[i] = mine[0] + (mine[1:] & ~mine[:-1]).sum()
                data = data[~mine]
            kept[i] = data.tobytes()
            begin = end
        return pa.table([
            chunk.docs["id"], pa.array(sizes.astype(np.int64)), pa.array(removed.astype(np.int64)),
            pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
            names=schema.names)

    def of_chunk(notes: DataFrame, function, out) -> DataFrame:
        return dealt.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(function, out)

    sent = of_chunk(copies, send_anchors, "chunk int, bucket int, data binary, n binary")
    known = copies.unionByName(sent.groupBy("bucket").applyInArrow(flag_anchors, NOTES))
    items = of_chunk(known, send_segments,
                     "chunk int, bucket int, n long, size long, sizes binary, data binary")
    settled = known.unionByName(items.groupBy("bucket").applyInArrow(settle, NOTES))
    return of_chunk(settled, remove, schema)
