"""Batched calls of a caller-supplied model, and the stop-after-N-successes loop."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.paths import components
from corpusmill.operators.ordering import numbered
from corpusmill.storage import materialise, scratch_path, with_counts, write_observed

# Generation parameters and retry policy when the caller gives none.
MODEL_PARAMS = {"temperature": 0.25, "max_tokens": 4096, "timeout": 900}
RETRY_ATTEMPTS = 5
RETRY_DELAY_SECONDS = 10.0
CALL_ROWS = 512  # prompts a task holds as Python strings

# Builds the callable once per task; the callable takes messages and generation
# parameters and returns the response text, or raises.
ModelFactory = Callable[[], Callable[..., str]]

RESPONSE_SCHEMA = "response string, error string, attempts long"


def outcome_counters() -> dict[str, Column]:
    """What a stage counts while it writes its outcomes."""
    failed = F.col("error").isNotNull()
    return {"processed": F.count(F.when(~failed, 1)), "failed": F.count(F.when(failed, 1))}


def add_counts(a: dict, b: dict) -> dict:
    return {k: (a.get(k) or 0) + (b.get(k) or 0) for k in {**a, **b}}


def call_model(prompts: DataFrame, make_model: ModelFactory, params: dict | None = None,
               attempts: int = 1, delay: float = RETRY_DELAY_SECONDS,
               parallelism: int | None = None, in_flight: int = 1) -> DataFrame:
    """Each row's ``prompt`` gives way to a response or an error, and the attempts it took.

    Other columns are carried along, so nothing has to be joined back. ``attempts`` above
    one retries a failed call after ``delay`` seconds. ``parallelism`` is the number of tasks
    that call; a lost task repeats its own calls, so many small tasks are better than few.
    ``in_flight`` calls wait at the same time in a task, which is what a core is left with when
    a call takes minutes; above one the model must take calls from several threads.
    Write the result before branching on it (``materialise``): evaluating it twice would
    call the model twice.
    """
    settings = {**MODEL_PARAMS, **(params or {})}
    kept = [f for f in prompts.schema if f.name != "prompt"]
    names, kinds = [f.name for f in kept], [pa.string(), pa.string(), pa.int64()]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + [RESPONSE_SCHEMA])

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()

        def one(prompt):
            error = None
            for attempt in range(1, attempts + 1):
                try:
                    text = model([{"role": "user", "content": prompt}], **settings)
                    return text.strip(), None, attempt
                except Exception as problem:  # one bad record must not stop the others
                    error = f"{type(problem).__name__}: {problem}"
                    if attempt < attempts and delay:
                        time.sleep(delay)
            return None, error, attempts

        with ThreadPoolExecutor(in_flight) as pool:
            for rows in batches:
                for start in range(0, rows.num_rows, CALL_ROWS):
                    some = rows.slice(start, CALL_ROWS)
                    answers = list(pool.map(one, some.column("prompt").to_numpy(
                        zero_copy_only=False)))
                    yield pa.RecordBatch.from_arrays(
                        [some.column(n) for n in names]
                        + [pa.array(values, kind) for values, kind in zip(zip(*answers), kinds)],
                        names=[*names, "response", "error", "attempts"])

    if parallelism:
        prompts = prompts.repartition(parallelism)
    return prompts.mapInArrow(respond, schema)


def in_chunks(rows: DataFrame, total: int, chunk_rows: int, files: int,
              handle: Callable[[DataFrame, int], None]) -> None:
    """``handle`` the ``total`` rows in chunks of about ``chunk_rows``, one after the other.

    The rows are written down as files, ``files`` to a chunk, and come back as a stream of these, a
    chunk to a micro-batch; what ``handle`` saves of a chunk is saved before the next one is begun.
    It gets a chunk and its number. Rows that fit one chunk are handled as they are.
    """
    if total <= chunk_rows:
        handle(rows, 0)
        return
    spark = rows.sparkSession
    folder, progress = scratch_path(spark, "chunks"), scratch_path(spark, "chunk-progress")
    rows.repartition(-(-total * files // chunk_rows)).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", progress)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def until_successes(candidates: DataFrame, limit: int | None,
                    run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run candidates (file_id, ...) in path order until ``limit`` of them succeed.

    ``run`` turns a batch into rows with ``file_id`` and ``error``. Each round takes the
    next rows after the last one tried, as many as successes are missing; so no row is tried
    that the one-by-one order would not have tried. Without a limit there is one round over
    everything. ``candidates`` should be a written table: they are numbered once and written
    in that order, so a round reads its slice by file statistics and none passes through one
    task. All rounds write into one folder.
    """
    if not limit:
        return materialise(run(candidates), "outcomes", outcome_counters())
    counts: dict = {}
    candidates = materialise(numbered(
        candidates.withColumn("_key", components(F.col("file_id"))), "_key").drop("_key"),
        "candidates")
    total, tried, missing = candidates.count(), 0, limit
    folder = scratch_path(candidates.sparkSession, "outcomes")
    while True:
        done = run(candidates.where(F.col("start").between(tried, tried + missing - 1))
                   .drop("start"))
        counted = write_observed(done, folder, outcome_counters(), mode="append")
        counts = add_counts(counts, counted)
        tried += missing
        missing = limit - counts["processed"]
        if missing <= 0 or tried >= total:
            return with_counts(
                candidates.sparkSession.read.schema(done.schema).parquet(folder), counts)
