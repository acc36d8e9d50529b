"""The saved fingerprints: legacy JSON in, flat (stage, file_id, hash) rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.storage import exists

STATE_SCHEMA = "stage string, file_id string, hash string"


def parse_state(documents: DataFrame, json_column: str) -> DataFrame:
    """State documents {stage: {file_id: hash}} as rows; a malformed one gives none."""
    stages = F.from_json(json_column, "map<string,map<string,string>>")
    return (documents.select(F.explode(stages).alias("stage", "_ids"))
            .select("stage", F.explode("_ids").alias("file_id", "hash")))


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """A legacy state file. Absent or malformed means nothing has been processed."""
    if not exists(spark, path):
        return spark.createDataFrame([], STATE_SCHEMA)
    return parse_state(spark.read.text(path, wholetext=True), "value")
