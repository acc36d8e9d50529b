"""The harvest as a stream over append-only document versions."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.changes import changed_only, state_of
from corpusmill.operators.lookup import fetch
from corpusmill.operators.fingerprints import file_fingerprint
from corpusmill.plans.harvest import STAGE, eligible_files, staged_text
from corpusmill.plans.workspace import Workspace, new_run
from corpusmill.storage import materialise

VERSIONS_SCHEMA = "path string, version long, content binary"


def read_versions(spark: SparkSession, folder: str,
                  max_files_per_batch: int = 1000) -> DataFrame:
    """Versions (path, version, content) as they are added to ``folder``. A live tree will
    not do as a source: a file rewritten in place is not a new file to the stream."""
    return (spark.readStream.schema(VERSIONS_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_batch).parquet(folder))


def harvest_versions(versions: DataFrame, ws: Workspace, config: dict, harvested_date: str,
                     checkpoint: str, mode: str = "compat") -> StreamingQuery:
    """Stage the last version of each path of every batch if it is newer than the last one
    seen and its hash is new.

    Versions may arrive in any order and in any batches: an older one never replaces a newer
    one, and a fresh checkpoint finds every version known, however the replay is cut into batches.
    Versions that are not UTF-8 go to quarantine, under the batch's own name. So a batch that is
    replayed after a crash changes nothing, in the tables and in the quarantine.
    """
    run, stream = new_run(), md5(checkpoint.encode()).hexdigest()

    def stage(batch: DataFrame, batch_id: int) -> None:
        path = F.col("path")
        eligible = eligible_files(batch, config, mode)
        readable = F.try_validate_utf8(F.col("content").cast("string")).isNotNull()
        found = eligible.where(readable)
        bad = materialise(eligible.where(~readable).select(
            path.alias("file_id"), F.concat(F.lit("not UTF-8, version "), F.col("version").cast(
                "string")).alias("error"), F.lit(0).cast("long").alias("attempts")), "unreadable")
        if not bad.isEmpty():
            ws.quarantine(bad, STAGE, stream, batch_id)
        # only hashes go through the aggregation, bodies are fetched for what is left
        last = found.groupBy("path").agg(
            F.max_by(F.struct("version", file_fingerprint(F.col("content")).alias("hash")),
                     "version").alias("_last"))
        latest = materialise(
            last.select(path.alias("file_id"), "_last.version", "_last.hash"), "stream-batch")
        seen = fetch(ws.versions.read(), latest.select(F.col("file_id").alias("path")), "path").select(
            path.alias("file_id"), F.col("version").alias("_seen"))
        current = materialise(latest.join(seen, "file_id", "left").where(
            F.col("_seen").isNull() | (F.col("version") > F.col("_seen"))).drop("_seen"),
            "stream-newer")
        # a batch is small and the state is not: look its ids up without moving the state
        known = fetch(ws.state.read(), current.select("file_id"), "file_id")
        work = materialise(changed_only(current, known, STAGE), "stream-work")
        wanted = work.select(F.col("file_id").alias("path"), "version",
                             F.col("hash").alias("source_hash"))
        # a version may have been delivered twice
        bodies = fetch(found, wanted, ["path", "version"])
        ws.raw.apply(bodies.dropDuplicates(["path"]).select(
            "path", staged_text(path, F.col("content"), harvested_date).alias("text"),
            "source_hash"), run=run, batch=batch_id)
        ws.state.apply(state_of(work, STAGE), run=run, batch=batch_id)
        # last, so that a batch that died half-way is taken up again
        ws.versions.apply(current.select(F.col("file_id").alias("path"), "version"),
                          run=run, batch=batch_id)

    return (versions.writeStream.foreachBatch(stage)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
