"""Token ids on disk under one canonical, length-limited Huffman code (operator 8).

File format: a table of blocks, one binary value each, in ascending order of (part, block).
A block is: magic ``HCB1``; five little-endian 64-bit numbers (documents, ids, ids per
checkpoint, checkpoints, payload bytes); document lengths in ids (64-bit each); the bit offset
of every checkpoint (64-bit each); the payload, most significant bit first, four zero bytes at
its end. Blocks hold whole documents, so one can be read without the others; checkpoints let a
block's ids be decoded from many places at once. The code itself is a table (id, bits): codes of
equal length ascend with the id, shorter ones come first.

Blocks are written by Spark's Parquet committer into the shared folder, so a lost executor
repeats its tasks and leaves no half file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.tokens import SLICE_BYTES, default_path, encoder
from corpusmill.llm.words import slices, strings
from corpusmill.storage import broadcast_if_small, materialise

MAX_BITS = 20
CHECKPOINT_IDS = 256
BLOCK_IDS = 1 << 19
MAGIC = b"HCB1"


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits`` by package-merge; ids that never occur get
    none, a single id gets one bit."""
    ids = sorted((n, i) for i, n in counts.items() if n > 0)
    if len(ids) > 1 << max_bits:
        raise ValueError(f"{len(ids)} ids do not fit into {max_bits} bits")
    if len(ids) < 2:
        return {i: 1 for _, i in ids}
    weight = np.array([n for n, _ in ids], np.float64)
    levels, previous = [], np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate((weight, previous))
        order = np.argsort(merged, kind="stable")
        levels.append(order)
        merged = merged[order]
        even = len(merged) // 2 * 2
        previous = merged[:even:2] + merged[1:even:2]
    lengths = np.zeros(len(ids), np.int64)
    take = 2 * (len(ids) - 1)
    for order in reversed(levels):
        chosen = order[:take]
        lengths[chosen[chosen < len(ids)]] += 1
        take = 2 * int((chosen >= len(ids)).sum())
    return {i: int(k) for (_, i), k in zip(ids, lengths)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bits, codes) in canonical order: by length, then by id."""
    order = sorted((k, i) for i, k in lengths.items())
    codes, code, last = [], 0, order[0][0] if order else 0
    for bits, _ in order:
        code <<= bits - last
        last = bits
        codes.append(code)
        code += 1
    return (np.array([i for _, i in order], np.int64),
            np.array([k for k, _ in order], np.int64), np.array(codes, np.int64))


class Code:
    """Encoding by id and decoding by table lookup."""

    def __init__(self, lengths: dict[int, int]):
        ids, bits, codes = canonical(lengths)
        size = int(ids.max()) + 1 if len(ids) else 1
        self.bits, self.codes = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.bits[ids], self.codes[ids] = bits, codes
        self.width = int(bits.max()) if len(bits) else 1
        spans = 1 << (self.width - bits)
        self.symbol = np.repeat(ids, spans).astype(np.uint32)
        self.length = np.repeat(bits, spans).astype(np.int64)

    def block(self, ids: np.ndarray, lengths: np.ndarray, every: int = CHECKPOINT_IDS) -> bytes:
        """One block holding documents of these lengths, laid end to end in ``ids``."""
        bits = self.bits[ids]
        at = np.cumsum(bits) - bits
        total = int(at[-1] + bits[-1]) if len(ids) else 0
        word, room = at >> 5, 64 - (at & 31) - bits  # a code lies within two 32-bit words
        value = self.codes[ids].astype(np.uint64) << room.astype(np.uint64)
        words = (total + 31) // 32
        high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words + 1)
        low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)
        payload = (high + low)[:words + 1].astype(np.uint32).astype(">u4").tobytes()
        marks = at[::every].astype("<i8")
        head = struct.pack("<5q", len(lengths), len(ids), every, len(marks), len(payload))
        return b"".join((MAGIC, head, np.asarray(lengths, "<i8").tobytes(), marks.tobytes(),
                         payload))

    def read(self, block: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, document lengths) of a block; all checkpoints advance together."""
        if block[:4] != MAGIC:
            raise ValueError("not a block of this format")
        n_docs, n, every, n_marks, n_bytes = struct.unpack_from("<5q", block, 4)
        lengths = np.frombuffer(block, "<i8", n_docs, 44)
        at = np.frombuffer(block, "<i8", n_marks, 44 + 8 * n_docs).copy()
        data = np.frombuffer(block, np.uint8, n_bytes, 44 + 8 * (n_docs + n_marks))
        data = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        out = np.zeros((every, n_marks), np.uint32)
        drop = np.uint32(32 - self.width)
        for step in range(min(every, n)):
            live = n_marks if step < n - (n_marks - 1) * every else n_marks - 1
            here = at[:live]
            peek = (window[here >> 3] << (here & 7).astype(np.uint32)) >> drop
            out[step, :live] = self.symbol[peek]
            at[:live] += self.length[peek]
        return out.T.reshape(-1)[:n], lengths


def tokenize(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int) -> DataFrame:
    """(id, ids, n): whole texts as 16- or 32-bit little-endian ids."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType),
                           T.StructField("ids", T.BinaryType()),
                           T.StructField("n", T.LongType())])

    def run(batches):
        encode = encoder(path, end_id, False).encode
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in slices(texts, SLICE_BYTES):
                ids = encode(texts.slice(a, b - a))
                at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + b - a + 1]
                flat = np.frombuffer(ids.buffers()[2], "<u4")[at[0] // 4:at[-1] // 4]
                n = np.diff(at) // 4
                packed = np.concatenate(([0], np.cumsum(n))) * 2
                if len(flat) and flat.max() > 0xFFFF:
                    raise ValueError("the vocabulary must have at most 65,536 ids")
                narrow = pa.Array.from_buffers(pa.large_binary(), b - a, [
                    None, pa.py_buffer(packed.astype(np.int64)),
                    pa.py_buffer(flat.astype("<u2"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), narrow.cast(pa.binary()), pa.array(n)],
                    names=schema.names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit ids of a column of rows, and where each row starts (and the last one ends)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    ids = np.frombuffer(column.buffers()[2] or b"", "<u2")[at[0] // 2:at[-1] // 2]
    return ids, (at - at[0]) // 2


def count_ids(tokens: DataFrame) -> DataFrame:
    """(token, count) over all ids; a task sends one row per distinct id at most."""
    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_flat(batch.column(0))[0], minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])],
                                         names=["token", "n"])

    return (tokens.select("ids").mapInArrow(run, "token long, n long")
            .groupBy("token").agg(F.sum("n").alias("n")))


def _gathered(batches, most: int):
    """Whole documents of the sorted rows in runs of about ``most`` ids: (document ids, lengths,
    ids)."""
    keys, lengths, ids, held = [], [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, at = _flat(batch.column(1))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + most - held))
            end = min(max(end, start + 1), batch.num_rows)
            keys.append(batch.column(0).slice(start, end - start))
            lengths.append(np.diff(at[start:end + 1]))
            ids.append(flat[at[start]:at[end]])
            held += int(at[end] - at[start])
            if held >= most:
                yield pa.concat_arrays(keys), np.concatenate(lengths), np.concatenate(ids)
                keys, lengths, ids, held = [], [], [], 0
            start = end
    if keys:
        yield pa.concat_arrays(keys), np.concatenate(lengths), np.concatenate(ids)


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  tokenizer: str | None = None, end_id: int = 2, max_bits: int = MAX_BITS,
                  block_ids: int = BLOCK_IDS) -> tuple[DataFrame, dict[int, int]]:
    """Write the corpus in ascending id order; returns (blocks, code lengths).

    ``blocks`` reads back what was written: part, block, first id position within the part,
    number of ids, document ids, and the block itself. Null texts are empty and hold the end id
    alone; null document ids come first; rows with one id are kept, side by side, shorter ones
    first. An empty table gives no blocks.
    """
    tokens = materialise(
        tokenize(docs, doc_id, text, tokenizer or default_path("word_bpe_49k.json"), end_id),
        "tokens")
    counts = {r["token"]: r["n"] for r in count_ids(tokens).collect()}  # the vocabulary at most
    lengths = code_lengths(counts, max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(lengths)
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(tokens.schema[doc_id].dataType)),
        T.StructField("data", T.BinaryType())])
    kind = pa.RecordBatch  # the record type yielded below

    def run(batches):
        code, part, first = Code(shared.value), TaskContext.get().partitionId(), 0
        for number, (keys, sizes, ids) in enumerate(_gathered(batches, block_ids)):
            yield kind.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([first]), pa.array([len(ids)]),
                 pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                 pa.array([code.block(ids, sizes)], pa.binary())],
                names=schema.names)
            first += len(ids)

    ordered = tokens.repartitionByRange(F.col(doc_id)).sortWithinPartitions(doc_id, "n", "ids")
    blocks = ordered.select(doc_id, "ids").mapInArrow(run, schema)
    return materialise(blocks, "huffman-blocks"), lengths


def decode_corpus(blocks: DataFrame, lengths: dict[int, int], doc_id: str = "doc_id",
                  with_ids: bool = False) -> DataFrame:
    """Documents read back: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shared = blocks.sparkSession.sparkContext.broadcast(lengths)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per written part; the running sum over them orders the parts, nothing more.
    parts = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = blocks.join(broadcast_if_small(materialise(parts, "parts")), "part").select(
        "data", "doc_ids", (F.col("base") + F.col("first")).alias("at"))
    schema = T.StructType([
        T.StructField(doc_id, blocks.schema["doc_ids"].dataType.elementType),
        T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType())]
        + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches):
        code = Code(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n = code.read(batch.column(0)[i].as_buffer().to_pybytes())
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = [raw[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                columns = [batch.column(1)[i].values, pa.array(batch.column(2)[i].as_py() + ends - n),
                           pa.array(n), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([c.tobytes() for c in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return placed.mapInArrow(run, schema)
