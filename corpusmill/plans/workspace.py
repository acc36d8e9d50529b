"""The tables a run works on, and the steps that all stages share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.changes import changed_only as diff
from corpusmill.operators.lookup import fetch
from corpusmill.operators.model import (
    MODEL_PARAMS, ModelFactory, add_counts, call_model, in_chunks, outcome_counters, until_successes)
from corpusmill.sources.state import STATE_SCHEMA
from corpusmill.sources.tables import KeyedTable
from corpusmill.sources.trees import FingerprintTree
from corpusmill.storage import materialise, observed, with_counts


@dataclass
class Workspace:
    """Staged documents, published documents, saved hashes, findings and the report."""

    spark: SparkSession
    root: str
    raw: KeyedTable = field(init=False)
    wiki: KeyedTable = field(init=False)
    state: KeyedTable = field(init=False)
    findings: KeyedTable = field(init=False)
    versions: KeyedTable = field(init=False)
    reports: KeyedTable = field(init=False)
    tree: FingerprintTree = field(init=False)

    def __post_init__(self):
        def table(name, keys, schema):
            return KeyedTable(self.spark, f"{self.root}/{name}", keys, schema)

        self.raw = table("raw", ["path"], "path string, text string, source_hash string")
        self.wiki = table("wiki", ["path"], "path string, text string")
        self.state = table("state", ["stage", "file_id"], STATE_SCHEMA)
        self.versions = table("versions", ["path"], "path string, version long")
        self.reports = table("report", ["page"], "page long, text string")
        self.findings = table("findings", ["file_id"], "file_id string, finding string")
        self.tree = FingerprintTree(self.spark, f"{self.root}/tree")

    def save_report(self, pages: DataFrame) -> None:
        """Replace the report; a run that dies on the way leaves the previous one."""
        pages = materialise(pages.select("page", "text"), "report")
        old = self.reports.read().select("page")
        self.reports.apply(pages, deletes=old.join(pages, "page", "left_anti"))

    def report(self) -> DataFrame:
        return self.reports.read()

    def quarantine(self, failed: DataFrame, stage: str, run: str | None = None,
                   batch: int = 0) -> None:
        """Keep the failed records and why; a bad run's rows are never dropped silently. A batch of
        a run has a folder of its own, so that a replay writes the same rows in the same place."""
        failed.select(F.lit(stage).alias("stage"), "file_id", "error", "attempts").write.mode(
            "overwrite").parquet(f"{self.root}/quarantine/run={run or new_run()}/"
                                 f"batch={stage}-{batch:08d}")


@dataclass
class Model:
    """How to reach the model: a factory that runs once per task, and the call policy."""

    make: ModelFactory
    params: dict | None = None
    attempts: int = 1
    delay: float = 0.0
    parallelism: int | None = None
    in_flight: int = 1
    chunk_rows: int = 10_000  # prompts whose answers are saved together

    def answer(self, prompts: DataFrame, defaults: dict) -> DataFrame:
        """``defaults`` is the configured part; only generation parameters are taken from it."""
        known = {k: v for k, v in defaults.items() if k in MODEL_PARAMS}
        return call_model(prompts, self.make, {**known, **(self.params or {})},
                          self.attempts, self.delay, self.parallelism, self.in_flight)


def select_work(current: DataFrame, ws: Workspace, stage: str, only_changed: bool) -> DataFrame:
    """(file_id, hash) rows to process, written down so bodies can be fetched by key."""
    if only_changed:
        current = diff(current, ws.state.read(), stage).select("file_id", "hash")
    return materialise(current, f"{stage}-work", {"processed": F.count(F.lit(1))}, measured=True)


def new_run() -> str:
    return uuid.uuid4().hex


def ask_documents(ws: Workspace, stage: str, docs: DataFrame, prompt: Column, model: Model,
                  defaults: dict, only_changed: bool, limit: int | None,
                  save: Callable[[DataFrame, str, int], None]) -> DataFrame:
    """Model outcomes for ``docs`` (file_id, text, hash), ``prompt`` being made from these.

    The model is asked in chunks. ``save`` gets the outcomes of a chunk, the run and the chunk's
    number, and puts documents and hashes away before the next chunk is asked; so a run that dies
    has lost one chunk of answers, and the next one over what changed asks for the others only.
    With a limit a round of candidates is a chunk. A full run moves documents once, without a join.
    """
    run = new_run()

    def ask(batch: DataFrame) -> DataFrame:
        return model.answer(batch.select("file_id", "hash", prompt.alias("prompt")), defaults)

    if limit:
        work = select_work(docs.select("file_id", "hash"), ws, stage, only_changed)
        outcomes = until_successes(
            work, limit, lambda batch: ask(fetch(docs.select("file_id", "text"), batch, "file_id")))
        save(outcomes, run, 0)
        return outcomes
    if only_changed:
        work = select_work(docs.select("file_id", "hash"), ws, stage, True)
        docs, total = fetch(docs.select("file_id", "text"), work, "file_id"), \
            observed(work)["processed"]
    else:
        total = docs.count()
    return answer_in_chunks(ws, docs, total, model, ask, run, save)


def answer_in_chunks(ws: Workspace, rows: DataFrame, total: int, model: Model,
                     ask: Callable[[DataFrame], DataFrame], run: str,
                     save: Callable[[DataFrame, str, int], None]) -> DataFrame:
    """``ask`` for the rows chunk by chunk and ``save`` each chunk's outcomes before the next."""
    chunks: list[DataFrame] = []

    def handle(chunk: DataFrame, number: int) -> None:
        outcomes = materialise(ask(chunk), "outcomes", outcome_counters())
        save(outcomes, run, number)
        chunks.append(outcomes)

    files = model.parallelism or ws.spark.sparkContext.defaultParallelism
    in_chunks(rows, total, model.chunk_rows, files, handle)
    counts = reduce(add_counts, [observed(c) for c in chunks])
    return with_counts(ws.spark.read.schema(chunks[0].schema).parquet(
        *[path for c in chunks for path in c.inputFiles()]) if len(chunks) > 1 else chunks[0], counts)


def run_counts(outcomes: dict[str, DataFrame]) -> dict[str, dict[str, int]]:
    """Records processed and failed by stage, as counted while the stages wrote; no scan."""
    return {stage: observed(rows) for stage, rows in outcomes.items() if observed(rows)}
