"""Ignore rules that come as tables: per-directory rule files and very long lists."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.paths import components
from corpusmill.functions.rules import wildmatch_rule
from corpusmill.functions.ruleset import GRAMS, SHARED, RuleSet, grams_of, judge_files
from corpusmill.storage import broadcast_if_small, materialise, observed

# Paths that meet a rule file in one go, about; a file with more of them is met in several places.
GROUP_PATHS = 100_000

# the rule translator travels with the task: executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[wildmatch_rule.__module__])
cloudpickle.register_pickle_by_value(sys.modules[RuleSet.__module__])


def compile_rules(rules: DataFrame) -> DataFrame:
    """Add regex, negated, token, fragments and grams to rows with a ``pattern``; blanks and
    comments go. ``grams`` are what a rule can be filed under besides its token."""
    schema = "regex string, negated boolean, token string, fragments array<string>, " \
             "grams array<string>"

    @F.pandas_udf(schema)
    def compiled(patterns: pd.Series) -> pd.DataFrame:
        found = []
        for rule in map(wildmatch_rule, patterns):
            found.append((*rule[:3], list(rule.fragments), grams_of(rule)) if rule else (None,) * 5)
        return pd.DataFrame(found, columns=["regex", "negated", "token", "fragments", "grams"],
                            dtype=object)

    return (rules.withColumn("_rule", compiled("pattern"))
            .select(*rules.columns, "_rule.*").where(F.col("regex").isNotNull()))


# --- rule files of directories -----------------------------------------------

def ignored_by_gitrules(paths: DataFrame, rules: DataFrame,
                        group_paths: int = GROUP_PATHS) -> DataFrame:
    """Paths (path, tracked) with an ``ignored`` flag from rules (base_dir, seq, pattern).

    A rule sees the path relative to its own directory; the deepest directory that has an
    opinion decides, and there the last matching rule. Tracked files are never ignored.

    A rule file and the paths below its directory meet in one task, rules first, and the rules are
    indexed once for all of these paths: a path tries the few rules that share a name or some
    characters with it, however many the file holds. A directory with very many paths is met in
    parts, each with its own copy of the rules. Only paths and rules are shuffled.
    """
    depth = F.size(components(F.col("path"))) - 1
    ancestors = F.transform(
        F.sequence(F.lit(0), depth),
        lambda n: F.struct(n.alias("depth"), F.array_join(
            F.slice(components(F.col("path")), F.lit(1), n), "/").alias("base_dir")))
    above = paths.where(~F.col("tracked")).select("path", F.inline(ancestors))
    files = broadcast_if_small(materialise(
        rules.select("base_dir").distinct(), "rule-files", measured=True))
    spread = broadcast_if_small(materialise(
        above.select("base_dir").join(files, "base_dir").groupBy("base_dir")
        .agg((F.floor(F.count(F.lit(1)) / group_paths) + 1).cast("int").alias("_parts")),
        "rule-file-parts", measured=True))
    below = above.join(spread, "base_dir").select(
        "base_dir", F.pmod(F.xxhash64("path"), F.col("_parts")).cast("int").alias("_part"),
        F.lit(True).alias("_is_path"), F.lit(None).cast("string").alias("pattern"), "path", "depth",
        F.lit(None).cast("long").alias("seq"))
    copies = rules.join(spread, "base_dir").select(
        "base_dir", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
        F.lit(False).alias("_is_path"), "pattern", F.lit(None).cast("string").alias("path"),
        F.lit(0).alias("depth"), F.col("seq").cast("long").alias("seq"))
    opinions = (
        below.unionByName(copies).repartition("base_dir", "_part")
        .sortWithinPartitions("base_dir", "_part", "_is_path", "seq").drop("seq")
        .mapInPandas(judge_files, "path string, depth int, negated boolean"))
    ignored = (opinions.groupBy("path").agg(F.max_by("negated", "depth").alias("_negated"))
               .where(~F.col("_negated")).select("path", F.lit(True).alias("ignored")))
    return paths.join(ignored, "path", "left").withColumn(
        "ignored", F.coalesce("ignored", F.lit(False)))


# --- one long list of rules ----------------------------------------------------

def path_grams(path: Column, sizes: list[int]) -> Column:
    """The distinct grams of these sizes in a path."""
    def of(size: int) -> Column:
        if not size:
            return F.array(F.lit(""))
        last = F.length(path) - (size - 1)
        return F.when(last > 0, F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: path.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def nameless_candidates(paths: DataFrame, nameless: DataFrame) -> DataFrame:
    """(path, regex, seq, negated) of paths that have all literal text of a rule. ``nameless`` are
    compiled rules without a name, or with one that many share.

    An inverted index: each rule is filed under that gram of its literal text which the fewest
    paths have, and a path looks up its own grams. A rule with a gram that no path has is left
    out; of equal rules the last one counts.
    """
    path = F.col("path")
    sizes = [*GRAMS, 0]
    offered = materialise(
        nameless.groupBy("regex").agg(
            F.max_by(F.struct("seq", "negated", "fragments", "grams"), "seq").alias("_r"))
        .select("regex", "_r.*").withColumn("gram", F.explode("grams")).drop("grams"), "rule-grams",
        {f"size{n}": F.max(F.length("gram") == n) for n in sizes}, measured=True)
    sizes = [n for n in sizes if observed(offered)[f"size{n}"]]
    if not sizes:
        return paths.select("path").limit(0).selectExpr(
            "path", "cast(null as string) regex", "cast(null as long) seq", "false negated")
    lookups = paths.select("path", F.explode(path_grams(path, sizes)).alias("gram"))
    used = broadcast_if_small(offered.select("gram").distinct(), part_of=offered)
    common = lookups.join(used, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    found = F.struct("_n", "gram", "seq", "negated", "fragments")
    index = materialise(offered.join(common, "gram", "left").fillna(0, "_n").groupBy("regex").agg(
        F.min_by(found, "_n").alias("_r")).select("regex", "_r.*").where(F.col("_n") > 0).drop("_n"),
        "rule-index", measured=True)
    return (lookups.join(broadcast_if_small(index), "gram")
            .where(F.forall("fragments", lambda f: F.contains(path, f)))
            .select("path", "regex", "seq", "negated"))


def rule_antijoin(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths no rule of (seq, pattern) ignores; the last matching rule decides.

    An equi-join, not every path against every rule: a rule is filed under a name (or
    ``*.ext``) that any path it matches must contain, a path looks up only its own
    components and their extensions, and the regex confirms. Rules without such a name, or with one
    that many rules share, are filed under a rare piece of their literal text instead
    (``nameless_candidates``). No rule is refused, none passes through the driver, and the plan is
    the same for any number of them.
    """
    written = materialise(compile_rules(rules), "compiled-rules", measured=True)
    crowded = written.groupBy("token").count().where(F.col("count") > SHARED).select(
        "token", F.lit(True).alias("_crowded"))
    compiled = written.join(crowded, "token", "left")
    by_name = F.col("token").isNotNull() & ~(
        F.coalesce("_crowded", F.lit(False)) & (F.size("grams") > 0))
    path = F.col("path")
    parts = components(path)
    endings = F.transform(
        F.filter(parts, lambda p: F.contains(p, F.lit("."))),
        lambda p: F.concat(F.lit("*."), F.substring_index(p, ".", -1)))
    filed = compiled.where(by_name).select("token", "regex", "seq", "negated")
    named = (
        paths.select("path", F.explode(F.array_distinct(F.concat(parts, endings))).alias("token"))
        .join(broadcast_if_small(filed, part_of=written), "token")
        .select("path", "regex", "seq", "negated"))
    nameless = compiled.where(~by_name).drop("_crowded")
    matched = named.unionByName(nameless_candidates(paths, nameless)).where(
        F.rlike(path, F.col("regex"))).select("path", "seq", "negated")
    ignored = (matched.groupBy("path").agg(F.max_by("negated", "seq").alias("_negated"))
               .where(~F.col("_negated")).select("path"))
    return paths.join(ignored, "path", "left_anti")
