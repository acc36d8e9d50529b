"""Arrow helpers that run inside tasks, and bounded samples of labelled rows."""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20


def strings(column) -> pa.Array:
    """One plain string array; null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def runs(ends: np.ndarray, most: int):
    """(start, stop) of runs of rows of about ``most``, by the end of each; a long row is a run alone."""
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES):
    """(start, stop) of runs of rows of about ``max_bytes``; one long text is a run alone."""
    for run in runs(np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(
            np.int64)), max_bytes):
        yield run
        pa.default_memory_pool().release_unused()
    give_back()


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive a stage, and what they keep for
    later use is missing in the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


_kept: dict[tuple, object] = {}


def kept(key: tuple, make):
    """What this process keeps for the tasks that follow: one thing, as workers outlive a stage and
    what an earlier stage kept is missing in the next one."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[key] = make()
    return _kept[key]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-cased words (runs of letters, marks and digits) of each text.

    Returns offsets (one more than texts), a code per word, and the distinct words by code.
    """
    spaced = pc.replace_substring_regex(
        pc.utf8_lower(texts), pattern=r"[^\p{L}\p{M}\p{N}]+", replacement=" ")
    parts = pc.split_pattern(pc.ascii_trim(spaced, " "), " ")
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    vocab = coded.dictionary.to_pylist()
    if "" in vocab:  # texts without words
        kept = codes != vocab.index("")
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        codes = codes[kept]
    return offsets, codes, vocab


def word_hashes(vocab: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not vocab:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(vocab, dtype=object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def per_text(values: np.ndarray, offsets: np.ndarray, reduce, empty) -> np.ndarray:
    """``reduce`` (a ufunc) over the rows of each text; ``empty`` where a text has none."""
    starts, stops = offsets[:-1], offsets[1:]
    out = np.full((len(starts), *values.shape[1:]), empty, dtype=values.dtype)
    full = stops > starts
    if full.any():
        out[full] = reduce.reduceat(values, starts[full], axis=0)
    return out


def held_out(doc_id: str) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def uniform(*keys: str) -> Column:
    """A number in [0, 1) fixed by the keys."""
    return F.pmod(F.xxhash64(F.lit("uniform"), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (all, if there are fewer), by key hash.

    The values of ``by`` are class labels, counted on the cluster and few; the choice is a
    filter, so no task gathers candidates.
    """
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect() if r[by] is not None}
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, most / n)])
    return rows.filter(uniform(key) < rate[F.col(by)])
