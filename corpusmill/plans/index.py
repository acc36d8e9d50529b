"""Roll the published role documents up into the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.rollup import (
    active_roles, assignment_union, category_assign, category_default, category_table,
    category_titles, index_document, priority_roles)
from corpusmill.plans.workspace import Workspace
from corpusmill.storage import materialise

# The two names of the index.
INDEX_NAMES = ["README.md", "index.md"]


def page_path(path: Column, page: Column) -> Column:
    """The first page keeps the document's path, page n is ``name.page-n.md``."""
    return F.when(page == 0, path).otherwise(F.concat(
        F.regexp_replace(path, r"\.md\z", ""), F.lit(".page-"), (page + 1).cast("string"),
        F.lit(".md")))


def index_files(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The same index under each of its names: (path, text). A page that is not the last one
    ends in a link to the next, so a reader of the named document reaches all of it."""
    pages = materialise(pages.select("page", "text"), "index-pages")
    last = pages.agg(F.max("page")).first()[0] or 0
    name = F.explode(F.array(*[F.lit(n) for n in names or INDEX_NAMES])).alias("name")
    link = F.concat(F.lit("\n[Next page]("), page_path(F.col("name"), F.col("page") + 1),
                    F.lit(")\n"))
    return pages.select("page", "text", name).select(
        page_path(F.col("name"), F.col("page")).alias("path"),
        F.when(F.col("page") < last, F.concat("text", link)).otherwise(F.col("text"))
        .alias("text"))


def build_index(active: DataFrame, listed: DataFrame, config: dict,
                priority: DataFrame | None = None) -> DataFrame:
    """Index pages from active roles (role), listed categories and priority (pos, role)."""
    default = config["default_category"]
    assigned = category_assign(listed, active)
    everything = materialise(  # the index reads it several times
        assignment_union(assigned, category_default(active, assigned, default)), "assignments")
    titles = category_titles(everything, listed, default, config["default_category_title"])
    first = None if priority is None else priority_roles(priority, active)
    return index_document(active.sparkSession, everything, titles, first, config["title"],
                          config["subtitle"], config["description"])


def write_index(ws: Workspace, config: dict, listed: DataFrame | None = None,
                priority: DataFrame | None = None) -> DataFrame:
    """Index the workspace's role documents. Categories and priority roles come from the
    configuration unless given as tables."""
    spark = ws.spark
    names = config["priority_roles"]
    if priority is None and names:
        priority = spark.createDataFrame(list(enumerate(names)), "pos int, role string")
    if listed is None:
        listed = category_table(spark, config.get("categories"))
    pages = build_index(active_roles(ws.wiki.read().select("path")), listed, config, priority)
    files = materialise(index_files(pages), "index")
    stale = ws.wiki.read().select("path").where(
        F.col("path").rlike(r"^(README|index)\.page-[0-9]+\.md\z"))
    ws.wiki.apply(files, deletes=stale.join(files, "path", "left_anti"))
    return files
