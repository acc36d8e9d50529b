"""What changed, what to keep, what to remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_only(current: DataFrame, state: DataFrame, stage: str) -> DataFrame:
    """Rows of (file_id, hash) whose recorded hash is missing or different.

    Takes and returns narrow rows: bodies are fetched afterwards for what is left, so the
    join shuffles ids and hashes, never documents.
    """
    known = state.where(F.col("stage") == stage).select("file_id", F.col("hash").alias("old_hash"))
    return (current.join(known, "file_id", "left")
            .where(~F.col("hash").eqNullSafe(F.col("old_hash"))))


def split_outcomes(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(succeeded, failed) rows of a model call."""
    return responses.where(F.col("error").isNull()), responses.where(F.col("error").isNotNull())


def state_of(done: DataFrame, stage: str) -> DataFrame:
    """State rows for the records that succeeded; failed ones keep their old hash and so
    come up again next time."""
    return done.select(F.lit(stage).alias("stage"), "file_id", "hash")


def stale_split(staged: DataFrame, ignored: Column) -> tuple[DataFrame, DataFrame]:
    """(removed, kept): staged documents that the rules now ignore, and the rest."""
    verdict = F.coalesce(ignored, F.lit(False))
    return staged.where(verdict), staged.where(~verdict)


def stage_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("stage", "outcome").agg(F.count(F.lit(1)).alias("n"))
