"""Content fingerprints of files and of groups of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import decode_text, squeeze_lines

# The members, in order, that make up a role's compact fingerprint.
COMPACT_MEMBERS = ("tasks/main.yml", "defaults/main.yml", "meta/main.yml")


def file_fingerprint(content: Column) -> Column:
    """SHA-256 of the raw bytes; an absent file has the empty fingerprint."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


# Characters of a node's name, from leaves to the root.
WIDTHS = (4, 2, 0)


def leaf_of(rel: Column) -> Column:
    """The leaf of a relative path: it is the path that chooses, so a file never moves."""
    return F.substring(F.sha2(rel.cast("binary"), 256), 1, WIDTHS[0])


def leaf_lines(files: DataFrame, group: str) -> DataFrame:
    """(group, node, line) of files (group, node, rel, hash)."""
    return files.select(group, "node", F.concat("rel", F.lit(":"), "hash").alias("line"))


def node_lines(nodes: DataFrame, group: str, width: int) -> DataFrame:
    """(group, node, line) of nodes (group, node, hash) for the parents of that width."""
    return nodes.select(group, F.substring("node", 1, width).alias("node"),
                        F.concat("node", F.lit(":"), "hash").alias("line"))


def hash_nodes(lines: DataFrame, group: str) -> DataFrame:
    """(group, node, hash, n): each node's hash of its sorted lines, and how many there are."""
    joined = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    return lines.groupBy(group, "node").agg(
        F.sha2(joined.cast("binary"), 256).alias("hash"), F.count("line").alias("n"))


def merkle_fingerprint(files: DataFrame, group: str, rel: str, file_hash: str) -> DataFrame:
    """One fingerprint per group from (relative path, file hash), for groups of any size.

    A three-level tree: files are spread over 65,536 leaves by the hash of their path, each
    leaf hashes its sorted lines, and 256 branches and then the root hash their children in
    order. A group that holds a third of a corpus is spread over 65,536 reduce keys, and
    every later level sees at most 256 rows per key. Only paths and hashes are shuffled.
    """
    children = leaf_lines(files.select(
        F.col(group), leaf_of(F.col(rel)).alias("node"), F.col(rel).alias("rel"),
        F.col(file_hash).alias("hash")), group)
    for width in WIDTHS:
        level = hash_nodes(children, group)
        children = node_lines(level, group, max(width - 2, 0))
    return level.select(group, F.col("hash").alias("fingerprint"))


def group_fingerprint(files: DataFrame, group: str, rel: str, content: str) -> DataFrame:
    """The tree fingerprint of each group's files, from their bytes; alike at every size."""
    hashed = files.select(group, rel, file_fingerprint(F.col(content)).alias("_file_hash"))
    return merkle_fingerprint(hashed, group, rel, "_file_hash")


def compact_fingerprint(files: DataFrame, group: str, rel: str, content: str) -> DataFrame:
    """MD5 of a role's functional part. Conditional maxima instead of a collected list:
    the partial aggregate keeps three strings per role whatever the role holds."""
    body = squeeze_lines(decode_text(F.col(content)))
    wanted = F.col(rel).isin(*COMPACT_MEMBERS)
    parts = files.select(group, F.when(wanted, F.col(rel)).alias("_rel"),
                         F.when(wanted, body).alias("_body"))
    kept = parts.groupBy(group).agg(*[
        F.max(F.when(F.col("_rel") == name, F.col("_body"))).alias(f"_m{i}")
        for i, name in enumerate(COMPACT_MEMBERS)])
    joined = F.concat(*[F.coalesce(f"_m{i}", F.lit("")) for i in range(len(COMPACT_MEMBERS))])
    return kept.select(group, F.md5(joined.cast("binary")).alias("fingerprint"))
