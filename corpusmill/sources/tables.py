"""Keyed tables kept as snapshots: a Parquet folder per run, and a list of the folders."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.operators.lookup import fetch, without
from corpusmill.storage import newest_text, put_text, write_observed

# A table of so many folders is written whole, as one, before the next run adds its own.
SNAPSHOT_RUNS = 16
BATCHES = 1 << 32  # more than a run has


class KeyedTable:
    """``apply`` writes the changed and removed keys of a run into a folder of their own and then
    puts down a new list, so a run that dies leaves the table as it was. Lists are numbered and
    never replaced: a second writer gets an error instead of losing a change.

    ``read`` gives the newest row of each key. A table of one folder is a plain scan; otherwise
    newest rows are found on keys alone, and rows of the first folder give way to them.

    A run may come in batches, each applied when it is done. A batch that is applied again takes
    its own place, so a replay changes nothing. Folders that are no longer listed stay until they are
    deleted by hand, so frames that were read before a snapshot can still be evaluated.

    With a ``layout``, key columns, each folder is written in their order, and a ``read`` with a
    condition on them skips the files and row groups that cannot meet it.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str,
                 layout: list[str] | None = None):
        self.spark, self.root, self.keys, self.schema = spark, root.rstrip("/"), keys, schema
        self.layout = layout

    def _list(self) -> tuple[int, list[dict]]:
        """The number of the newest list, and its folders from old to new."""
        name, text = newest_text(self.spark, f"{self.root}/lists")
        return (int(name.split(".")[0]), json.loads(text)) if name else (0, [])

    def _load(self, folders: list[str], where: Column | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, _deleted boolean, _seq long").option(
            "recursiveFileLookup", "true").parquet(*[f"{self.root}/{f}" for f in folders])
        return rows if where is None else rows.where(where)

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(*self.layout).sortWithinPartitions(
            *self.layout) if self.layout else rows

    def is_new(self) -> bool:
        return not self._list()[1]

    def read(self, where: Column | None = None) -> DataFrame:
        """The newest row of each key; ``where``, a condition on keys alone, reaches the scans."""
        runs = self._list()[1]
        columns = StructType.fromDDL(self.schema).fieldNames()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        base = [r["folder"] for r in runs[:1] if r["whole"]]
        newer = [r["folder"] for r in runs[len(base):]]
        first = self._load(base, where).where(~F.col("_deleted")).select(columns) if base else None
        if not newer:
            return first
        rows = self._load(newer, where)
        if len(newer) == 1 and runs[-1]["whole"]:
            newest = winners = rows
        else:
            winners = rows.groupBy(*self.keys).agg(F.max("_seq").alias("_seq"))
            newest = fetch(rows, winners, [*self.keys, "_seq"])
        newest = newest.where(~F.col("_deleted")).select(columns)
        if first is None:
            return newest
        return without(first, winners.select(self.keys), self.keys).unionByName(newest)

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None,
              run: str | None = None, batch: int = 0) -> DataFrame:
        """Put ``upserts`` in place of equal keys and drop the keys in ``deletes``; each key comes
        once. Returns the rows as written. With ``run`` this is one ``batch`` of several."""
        names = StructType.fromDDL(self.schema)
        parts = []
        if upserts is not None:
            parts.append(upserts.select(*names.fieldNames(), F.lit(False).alias("_deleted")))
        if deletes is not None:
            parts.append(deletes.select(
                *[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType)
                  .alias(f.name) for f in names], F.lit(True).alias("_deleted")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

        version, runs = self._list()
        known = [r for r in runs if run and r["run"] == run]
        if not known and len(runs) >= SNAPSHOT_RUNS:
            version, runs = self._snapshot(version)
        number = known[0]["number"] if known else version + 1
        folder = known[0]["folder"] if known else f"runs/{number:08d}-{uuid.uuid4().hex}"
        place = f"{folder}/{batch:08d}"
        counted = write_observed(
            self._laid_out(rows).withColumn("_seq", F.lit(number * BATCHES + batch).cast("long")),
            f"{self.root}/{place}", {"rows": F.count(F.lit(1))}, mode="overwrite")
        if not known and (counted["rows"] or not runs):  # an empty folder says nothing
            self._put(version + 1, [*runs, {"folder": folder, "number": number, "run": run,
                                            "whole": run is None}])
        return self._load([place]).where(~F.col("_deleted")).drop("_deleted", "_seq")

    def _put(self, version: int, runs: list[dict]) -> None:
        put_text(self.spark, f"{self.root}/lists", f"{version:08d}.json", json.dumps(runs))

    def _snapshot(self, version: int) -> tuple[int, list[dict]]:
        """The table as it is, written as one folder."""
        version += 1
        folder = f"runs/{version:08d}-{uuid.uuid4().hex}"
        self._laid_out(self.read()).withColumn("_deleted", F.lit(False)).withColumn(
            "_seq", F.lit(version * BATCHES).cast("long")).write.parquet(f"{self.root}/{folder}")
        runs = [{"folder": folder, "number": version, "run": None, "whole": True}]
        self._put(version, runs)
        return version, runs
