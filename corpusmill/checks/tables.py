"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2025-01-01T00:00:00+00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of five kinds of path, with a comment line and a blank line."""
    return table(spark, sf, "documents").select(
        F.expr("""CASE (doc_id div 20) % 5
            WHEN 0 THEN 'docs/'||source||'/'||lang||'_'||doc_id||'.md'
            WHEN 1 THEN 'roles/'||source||'/tasks/'||lang||'_'||doc_id||'/m'
                        ||((doc_id div 100) % 3)||'.yml'
            WHEN 2 THEN 'roles/'||source||'/defaults/'||lang||'_'||doc_id||'.yaml'
            WHEN 3 THEN 'archive/'||source||'/'||lang||'_'||doc_id||'.md'
            ELSE 'playbooks/wiki/'||source||'/'||lang||'_'||doc_id||'.md' END""").alias("path"),
        F.expr(r"'# '||lang||'\n  \n'||text").alias("text"), "doc_id", "lang", "source")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("path", F.col("text").cast("binary").alias("content"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus with its labels; quality and toxic are null for unlabelled documents."""
    return corpus(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")


def state(spark: SparkSession, sf: str, stage: str = "harvest") -> DataFrame:
    """Saved hashes: right for quality 1, outdated for quality 0, missing without label."""
    return labelled(spark, sf).where("quality is not null").select(
        F.lit(stage).alias("stage"), F.col("path").alias("file_id"),
        F.expr("sha2(if(quality = 0, text||'x', text), 256)").alias("hash"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Model outcomes by label: toxic documents fail, the others find something or not."""
    return labelled(spark, sf).select(
        F.col("path").alias("file_id"),
        F.expr("""CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN 'Issue: '||path
            WHEN quality = 1 THEN 'ok '||path ELSE 'Suggestions: '||path END""").alias("response"),
        F.expr("CASE WHEN toxic = 1 THEN 'refused' END").alias("error"),
        F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Categories and their roles from parts; roles repeat and sit in several categories."""
    return table(spark, sf, "part").select(
        F.expr("lower(p_type)||'_parts'").alias("cat"),
        F.expr("CASE WHEN p_type = 'PROMO' THEN 'Promotions' END").alias("title"),
        F.expr("CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'Size class '||lower(p_type) END")
        .alias("description"),
        F.expr("p_name||' '||p_brand").alias("role"))


def active(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").where("p_size <= 25").select(
        F.expr("p_name||' '||p_brand").alias("role"))
    suppliers = table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.col("s_name").alias("role"))
    return parts.unionByName(suppliers).distinct()


def priority(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("long").alias("pos"), F.col("s_name").alias("role"))


def media(spark: SparkSession, sf: str) -> DataFrame:
    """Media files named after pages; pages with a query string have a picture."""
    return table(spark, sf, "pages").select(F.expr("""'wiki/media/'||split_part(url, '/', 3)
        ||'/p.'||page_id||if(contains(url, '?'), '.png', '.svg')""").alias("path"))


def stub_model():
    """A deterministic model: the outcome depends on the prompt's length alone."""
    def make():
        def answer(messages, **params):
            n = len(messages[0]["content"])
            if n % 11 == 0:
                raise ValueError(f"refused {n}")
            if n % 7 == 0:
                return f"---\nkept: {n}\n---\n"
            return (f"Issue: {n} \n", f" ok {n}", f"Suggestions: {n}")[n % 3]
        return answer
    return make


def flaky_model():
    """Fails the first calls for a prompt: none to six of them, by the prompt's length.

    Calls for a prompt follow each other in a thread, so each thread remembers its last one alone.
    """
    def make():
        last = threading.local()

        def answer(messages, **params):
            text = messages[0]["content"]
            last.calls = last.calls + 1 if getattr(last, "text", None) == text else 1
            last.text = text
            if last.calls <= len(text) % 7:
                raise TimeoutError(f"busy {len(text)}")
            return f"done {len(text)}"
        return answer
    return make
