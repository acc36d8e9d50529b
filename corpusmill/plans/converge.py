"""All stages in order; each reads the table the one before it wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.changes import stage_counts
from corpusmill.operators.rollup import active_roles
from corpusmill.plans.compile import compile_docs
from corpusmill.plans.harvest import clean_up, harvest
from corpusmill.plans.index import write_index
from corpusmill.plans.ingest import ingest
from corpusmill.plans.lint import lint_docs
from corpusmill.plans.workspace import Model, Workspace


def converge(ws: Workspace, files: DataFrame, model: Model, config: dict, harvested_date: str,
             changed_only: bool = True, limit: int | None = None) -> dict[str, DataFrame]:
    """Outcomes by stage, and the documents removed and the roles the index lists."""
    removed = clean_up(ws, files, config)
    return {
        "removed": removed,
        "harvest": harvest(ws, files, config, harvested_date, changed_only, limit,
                           cleaned=True),
        "ingest": ingest(ws, files, model, config, changed_only, limit),
        "compile": compile_docs(ws, model, config, changed_only, limit),
        "lint": lint_docs(ws, model, config, changed_only, limit),
        "index": write_index(ws, config),
        "active": active_roles(ws.wiki.read().select("path")).select(
            F.col("role").alias("file_id")),
    }


def summary(outcomes: dict[str, DataFrame]) -> DataFrame:
    """(stage, outcome, n) of the records a run processed, of those that failed, of the
    documents it removed and of the active roles."""
    counted = {"removed": ("harvest", "removed"), "active": ("index", "active")}

    def marked(stage: str, rows: DataFrame) -> DataFrame:
        if stage in counted:
            return rows.select(*map(F.lit, counted[stage])).toDF("stage", "outcome")
        failed = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
        return rows.select(F.lit(stage).alias("stage"), F.when(failed, "failed").otherwise(
            "processed").alias("outcome"))

    return stage_counts(reduce(DataFrame.unionByName, [
        marked(stage, rows) for stage, rows in outcomes.items() if "file_id" in rows.columns]))
