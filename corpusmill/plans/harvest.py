"""Stage the documents of a tree: clean up, select, compare, add a header, save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusmill.functions.paths import components
from corpusmill.functions.rules import in_output_trees, is_ignored
from corpusmill.functions.text import add_frontmatter, decode_text
from corpusmill.operators.changes import stale_split, state_of
from corpusmill.operators.lookup import fetch
from corpusmill.operators.fingerprints import file_fingerprint
from corpusmill.operators.ordering import first_rows
from corpusmill.operators.rules_join import ignored_by_gitrules
from corpusmill.plans.config import SOURCE_TYPE
from corpusmill.plans.workspace import Workspace, select_work
from corpusmill.sources.files import scan_docs, scan_patterns
from corpusmill.storage import materialise, with_counts

STAGE = "harvest"


def staged_text(path: Column, content: Column, harvested_date: str) -> Column:
    return add_frontmatter(decode_text(content), {
        "original_path": path,
        "harvested_date": F.lit(harvested_date),
        "source_type": F.lit(SOURCE_TYPE),
    })


def _git_ignored(paths: DataFrame, rules: DataFrame | None, tracked: DataFrame | None):
    """Paths that per-directory rules drop; null rules mean there are none."""
    if rules is None:
        return None
    flagged = paths.select("path").withColumn("tracked", F.lit(False)) if tracked is None else \
        paths.select("path").join(tracked.select("path", F.lit(True).alias("tracked")),
                                  "path", "left").withColumn(
            "tracked", F.coalesce("tracked", F.lit(False)))
    return ignored_by_gitrules(flagged, rules).where("ignored").select("path")


def eligible_files(files: DataFrame, config: dict, mode: str = "compat") -> DataFrame:
    """Files that discovery finds and the configured rules keep. Path predicates only, so a
    scan applies them before it reads content."""
    path = F.col("path")
    outputs = [config["wiki_state_dir"], config["wiki_dir"]]
    return scan_patterns(files, config["harvest_rglob_patterns"]).where(
        ~in_output_trees(path, outputs) & ~is_ignored(path, config["harvest_ignore"], mode))


def selected_files(files: DataFrame, config: dict, git_rules: DataFrame | None = None,
                   tracked: DataFrame | None = None, mode: str = "compat") -> DataFrame:
    """Eligible files without those that per-directory rules drop."""
    found = eligible_files(files, config, mode)
    dropped = _git_ignored(found, git_rules, tracked)
    return found if dropped is None else found.join(dropped, "path", "left_anti")


def clean_up(ws: Workspace, files: DataFrame, config: dict, git_rules: DataFrame | None = None,
             tracked: DataFrame | None = None, mode: str = "compat",
             keep_deleted: bool = False) -> DataFrame:
    """Drop staged Markdown documents that are now ignored, and, unless ``keep_deleted``, those whose
    source is gone together with their saved hashes. Returns the removed (file_id)."""
    if ws.raw.is_new():
        return ws.spark.createDataFrame([], "file_id string")
    staged = scan_docs(ws.raw.read().select("path"))
    path = F.col("path")
    gone, _ = stale_split(staged, is_ignored(path, config["harvest_ignore"], mode))
    dropped = _git_ignored(staged, git_rules, tracked)
    if dropped is not None:
        gone = gone.unionByName(dropped).distinct()
    if not keep_deleted:
        present = selected_files(files, config, git_rules, tracked, mode).select("path")
        gone = gone.unionByName(staged.join(present, "path", "left_anti")).distinct()
    gone = materialise(gone, "stale")
    removed = gone.select(path.alias("file_id"))
    if gone.isEmpty():
        return removed
    ws.raw.apply(deletes=gone)
    if not keep_deleted:
        ws.state.apply(deletes=removed.select(F.lit(STAGE).alias("stage"), "file_id"))
    return removed


def harvest(ws: Workspace, files: DataFrame, config: dict, harvested_date: str,
            changed_only: bool = False, limit: int | None = None,
            git_rules: DataFrame | None = None, tracked: DataFrame | None = None,
            mode: str = "compat", keep_deleted: bool = False,
            cleaned: bool = False) -> DataFrame:
    """Stage ``files`` (path, content). Returns the processed (file_id, hash) rows.

    The staged documents are cleaned up first, unless the caller already did (``cleaned``). Bytes that are not UTF-8 put the file in quarantine instead of ending the run.
    """
    if not cleaned:
        clean_up(ws, files, config, git_rules, tracked, mode, keep_deleted)
    found = selected_files(files, config, git_rules, tracked, mode)
    readable = F.try_validate_utf8(F.col("content").cast("string")).isNotNull()
    hashed = found.withColumn("hash", file_fingerprint(F.col("content")))
    text = staged_text(F.col("path"), F.col("content"), harvested_date).alias("text")

    if changed_only or limit:
        checked = materialise(hashed.select(
            F.col("path").alias("file_id"), "hash", readable.alias("readable")), "checked")
        bad = checked.where(~F.col("readable")).select("file_id")
        work = select_work(checked.where("readable").select("file_id", "hash"), ws, STAGE,
                           changed_only)
        if limit:
            key = components(F.col("file_id"))
            work = materialise(first_rows(work.withColumn("_key", key), "_key", limit)
                               .drop("_key"), "limited", {"processed": F.count(F.lit(1))})
        bodies = fetch(eligible_files(files, config, mode), work.select(
            F.col("file_id").alias("path"), "hash"), "path")
        ws.raw.apply(bodies.select("path", text, F.col("hash").alias("source_hash")))
    else:  # one pass: saved hashes are read off the written rows, unreadable files are counted
        watch = Observation()
        staged = ws.raw.apply(
            hashed.observe(watch, F.count(F.when(~readable, 1)).alias("bad"),
                           F.count(F.when(readable, 1)).alias("good"))
            .where(readable).select("path", text, F.col("hash").alias("source_hash")))
        work = with_counts(staged.select(F.col("path").alias("file_id"),
                                         F.col("source_hash").alias("hash")),
                           {"processed": watch.get["good"], "failed": watch.get["bad"]})
        bad = found.where(~readable).select(F.col("path").alias("file_id")) \
            if watch.get["bad"] else None
    if bad is not None and not bad.isEmpty():
        ws.quarantine(bad.select("file_id", F.lit("not UTF-8").alias("error"),
                                 F.lit(0).cast("long").alias("attempts")), STAGE)
    ws.state.apply(state_of(work, STAGE))
    return work
