"""Have the model improve the staged documents that changed, and publish them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.rules import is_named
from corpusmill.functions.text import compile_prompt, truncate_text
from corpusmill.operators.changes import split_outcomes, state_of
from corpusmill.plans.config import MAX_DOCUMENT_CHARS
from corpusmill.plans.workspace import Model, Workspace, ask_documents
from corpusmill.sources.files import scan_docs

STAGE = "compile"


def compile_docs(ws: Workspace, model: Model, config: dict, changed_only: bool = False,
                 limit: int | None = None, hash_header: bool = False) -> DataFrame:
    """Returns (file_id, hash, response, error, attempts) of the tried documents.

    The compared hash is that of the source file, so a new harvest date alone changes
    nothing; ``hash_header`` compares the staged text, header included.
    """
    raw = scan_docs(ws.raw.read()).where(~is_named(F.col("path"), "index.md"))
    digest = F.sha2(F.col("text").cast("binary"), 256) if hash_header else F.col("source_hash")
    docs = raw.select(F.col("path").alias("file_id"), "text", digest.alias("hash"))
    prompt = compile_prompt(truncate_text(F.col("text"), MAX_DOCUMENT_CHARS),
                            config["compile_prompt"])

    def save(outcomes: DataFrame, run: str, chunk: int) -> None:
        done, failed = split_outcomes(outcomes)
        ws.wiki.apply(done.select(F.col("file_id").alias("path"), F.col("response").alias("text")),
                      run=run, batch=chunk)
        ws.state.apply(state_of(done, STAGE), run=run, batch=chunk)
        ws.quarantine(failed, STAGE, run, chunk)

    return ask_documents(ws, STAGE, docs, prompt, model, config["llm"], changed_only, limit, save)
