"""Where documents come from: file trees and tables of (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.paths import components, path_stem, rel_path
from corpusmill.functions.rules import matches_patterns

# Discovery patterns and ignored directories when none are configured.
HARVEST_PATTERNS = [
    "./*.md",
    "**/docs/**/*.md",
    "**/playbooks/**/*.md",
    "**/roles/**/*.md",
    "**/vars/**/*.md",
]
HARVEST_IGNORE = [
    ".continue/", "archive/", "inventory/", "molecule/", "plugins/", "save/", "tests/",
]


def read_files(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    """Files below ``root`` as (path, content, length, modificationTime), path relative.

    ``content`` is only read when a query uses it. ``name_glob`` narrows the listing itself.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(root).withColumn("path", rel_path(F.col("path"), root))


def scan_patterns(files: DataFrame, patterns: list[str] | None = None,
                  root_only: bool = False) -> DataFrame:
    """Files any pattern finds. One predicate for all patterns: a file found twice is
    still one row, without a union and a de-duplicating shuffle."""
    return files.where(matches_patterns(
        F.col("path"), HARVEST_PATTERNS if patterns is None else patterns, root_only))


def pattern_union(files: DataFrame, pattern_sets: list[list[str]]) -> DataFrame:
    """Union of several discoveries over one tree, each path once."""
    return scan_patterns(files, [p for patterns in pattern_sets for p in patterns])


def scan_roles(files: DataFrame, roles_dir: str = "roles") -> DataFrame:
    """Role directories that hold a file; an empty directory leaves no trace in a table."""
    found = F.regexp_extract("path", f"^{roles_dir}/([^/]+)/", 1)
    return files.select(found.alias("role")).where(F.col("role") != "").distinct()


def scan_docs(files: DataFrame, folder: str | None = None, recursive: bool = True) -> DataFrame:
    """Markdown files; ``recursive=False`` keeps those directly in ``folder``."""
    path = F.col("path")
    found = files.where(F.endswith(path, F.lit(".md")))
    if folder:
        found = found.where(F.startswith(path, F.lit(folder + "/")))
    if not recursive:
        depth = folder.count("/") + 2 if folder else 1
        found = found.where(F.size(components(path)) == depth)
    return found


def scan_assets(files: DataFrame, wiki_dir: str, media_dir: str = "media") -> DataFrame:
    """PNG files below the media folder: (path, stem, link), link relative to the wiki."""
    path = F.col("path")
    return (files.where(F.startswith(path, F.lit(f"{wiki_dir}/{media_dir}/"))
                        & F.endswith(path, F.lit(".png")))
            .select("path", path_stem(path).alias("stem"), rel_path(path, wiki_dir).alias("link")))
