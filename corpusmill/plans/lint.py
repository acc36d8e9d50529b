"""Have the model review the published documents that changed, and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.rules import is_named
from corpusmill.functions.text import is_finding, lint_prompt, truncate_text
from corpusmill.operators.changes import split_outcomes, state_of
from corpusmill.operators.rollup import lint_report
from corpusmill.plans.config import MAX_DOCUMENT_CHARS
from corpusmill.plans.workspace import Model, Workspace, ask_documents
from corpusmill.sources.files import scan_docs

STAGE = "lint"


def lint_docs(ws: Workspace, model: Model, config: dict, changed_only: bool = False,
              limit: int | None = None) -> DataFrame:
    """Writes the report of this run; findings also stay by document, so a report over all
    runs can be made from ``ws.findings``. Returns the outcomes as in ``compile_docs``."""
    wiki = scan_docs(ws.wiki.read()).where(~is_named(F.col("path"), "lint-report.md"))
    docs = wiki.select(F.col("path").alias("file_id"), "text",
                       F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    prompt = lint_prompt(F.concat(F.lit(config["wiki_dir"] + "/"), F.col("file_id")),
                         truncate_text(F.col("text"), MAX_DOCUMENT_CHARS),
                         config["lint_prompt"])

    def save(outcomes: DataFrame, run: str, chunk: int) -> None:
        done, failed = split_outcomes(outcomes)
        found = is_finding(F.col("response"))
        ws.findings.apply(
            done.where(found).select("file_id", F.col("response").alias("finding")),
            deletes=done.where(~found).select("file_id"), run=run, batch=chunk)
        ws.state.apply(state_of(done, STAGE), run=run, batch=chunk)
        ws.quarantine(failed, STAGE, run, chunk)

    outcomes = ask_documents(ws, STAGE, docs, prompt, model, config["llm"], changed_only, limit,
                             save)
    done, _ = split_outcomes(outcomes)
    ws.save_report(lint_report(done.where(is_finding(F.col("response"))).select(
        "file_id", F.col("response").alias("finding"))))
    return outcomes
