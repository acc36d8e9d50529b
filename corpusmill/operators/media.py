"""Attach the media section to the index document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.rollup import MEDIA_HEADING


def append_section(docs: DataFrame, section: DataFrame, path: str = "index.md") -> DataFrame:
    """Changed (path, text) rows after adding section pages (page, text) to ``path``.

    An earlier section is replaced, so a second run changes nothing. Without that document
    there are no rows. Pages after the first become documents next to it.
    """
    target = docs.where(F.col("path") == path)
    if target.isEmpty():
        return target.select("path", "text")
    body = target.select(
        F.lit(0).cast("long").alias("page"),
        F.substring_index("text", MEDIA_HEADING, 1).alias("body"),
        F.lit(None).cast("string").alias("section"))
    pages = section.select("page", F.lit(None).cast("string").alias("body"),
                           F.col("text").alias("section"))
    name = F.when(F.col("page") == 0, path).otherwise(F.concat(
        F.lit(path.removesuffix(".md") + ".media-"), (F.col("page") + 1).cast("string"),
        F.lit(".md")))
    return (body.unionByName(pages).groupBy("page")
            .agg(F.max("body").alias("body"), F.max("section").alias("section"))
            .select(name.alias("path"), F.concat_ws("", "body", "section").alias("text")))
