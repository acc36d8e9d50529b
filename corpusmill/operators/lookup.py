"""Pick rows of a large table by key without moving the table.

How depends on the measured size of the key table, which should be a written one:

1. few keys are broadcast as they are;
2. up to ``HASHED_KEYS`` keys are broadcast as 64-bit hashes, which sorts the large table into
   rows that cannot be meant and a few that can; only these take part in the exact join;
3. beyond that both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import BROADCAST_BYTES, measured_bytes

HASHED_KEYS = 8_000_000


def _by_hash(rows: DataFrame, wanted: DataFrame, keys: list[str], how: str) -> DataFrame:
    hashes = F.broadcast(wanted.select(F.xxhash64(*keys).alias("_hash")).distinct())
    return rows.withColumn("_hash", F.xxhash64(*keys)).join(hashes, "_hash", how).drop("_hash")


def fetch(rows: DataFrame, wanted: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is wanted, joined with the other columns of ``wanted``."""
    keys = [key] if isinstance(key, str) else key
    if measured_bytes(wanted) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wanted), keys)
    if wanted.count() <= HASHED_KEYS:
        rows = _by_hash(rows, wanted, keys, "left_semi")
    return rows.join(wanted, keys)


def without(rows: DataFrame, unwanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among ``unwanted``, a table of keys."""
    if measured_bytes(unwanted) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(unwanted), keys, "left_anti")
    if unwanted.count() > HASHED_KEYS:
        return rows.join(unwanted, keys, "left_anti")
    suspects = _by_hash(rows, unwanted, keys, "left_semi")
    return _by_hash(rows, unwanted, keys, "left_anti").unionByName(
        suspects.join(unwanted, keys, "left_anti"))
