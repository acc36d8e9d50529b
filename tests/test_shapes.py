"""Plans that hold at scale: what is read, what is shuffled, what is never done."""

import re

from pyspark.sql import functions as F

from conftest import SF
from corpusmill.checks import tables as t
from corpusmill.checks.queries import QUERIES
from corpusmill.operators import fingerprints as fp
from corpusmill.operators.changes import changed_only
from corpusmill.operators.rollup import category_assign

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    documents = t.table(spark, SF, "documents")
    narrow = plan(documents.select("doc_id", fp.file_fingerprint(F.col("text").cast("binary"))))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", narrow)
    assert "text" not in re.search(r"ReadSchema: (.*)", plan(QUERIES["scan_roles"](spark, SF)))[1]
    assert "html" not in plan(QUERIES["scan_assets"](spark, SF))


def test_the_diff_shuffles_hashes_not_bodies(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = t.files(spark, SF).select(
            F.col("path").alias("file_id"), fp.file_fingerprint(F.col("content")).alias("hash"))
        text = plan(changed_only(files, t.state(spark, SF), "harvest"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanged = re.findall(r"Exchange hashpartitioning\(file_id.*\n.*?(Project \[.*\])", text)
    assert exchanged and all("content" not in re.sub(r"sha2\(.*?\)", "", e) for e in exchanged)


def test_aggregations_combine_before_the_shuffle(spark):
    text = plan(QUERIES["stage_counts"](spark, SF))
    assert "partial_count" in text
    assert "partial_max" in plan(QUERIES["compact_fingerprint"](spark, SF))


def test_membership_joins_are_semi_joins(spark):
    assert "LeftSemi" in plan(category_assign(t.listed(spark, SF), t.active(spark, SF)))


def test_scalar_functions_need_no_shuffle(spark):
    for name in ("ignore_wildmatch", "compact_lines", "add_frontmatter", "truncate_text",
                 "title_case", "relative_link", "scan_patterns", "exclude_outputs"):
        assert "Exchange" not in plan(QUERIES[name](spark, SF)), name
