import fnmatch
import itertools
import subprocess
import time
from pathlib import Path, PurePosixPath

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import rules as r
from corpusmill.functions.ruleset import RuleSet
from corpusmill.operators.rules_join import (
    compile_rules, ignored_by_gitrules, nameless_candidates, rule_antijoin)
from corpusmill.sources.files import read_files, scan_docs, scan_patterns, scan_roles

PATHS = ["top.md", "a/top.md", "docs/x.md", "docs/a/x.md", "docs/a/b/x.md", "my/docs/x.md",
         "abc.md", "a/abc.md", "a.c.md", "keep.tmp", "b.tmp", "x.tmp/y", "save/a", "save/b/c",
         "z/save/a", "archive/x", "q/archive/y/z", "archive", "foo/bar", "foo/x/bar", "a/foo/bar",
         "lib/[x].md", "lib/x.md", "lib/y.md", "lib/!.md", "lib/a b", "#hash", "!bang", "we ird",
         "README.md", "sub/README.md", "tests/unit/t.py", "deep/a/b/c/d.log", "d.log", "ä/ö.md"]
RULES = [["archive/", "*.tmp", "/top.md", "docs/**/x.md", "a?c.md", "!keep.tmp", "save/**"],
         ["*.md", "!README.md"], ["foo/**/bar"], ["**/bar"], ["lib/[!x].md"], ["lib/[x-y].md"],
         ["lib/\\[x\\].md"], ["\\#hash", "\\!bang"], ["# comment", "", "/"], ["tests/"],
         ["deep/**/*.log"], ["**"], ["a/*"], ["**/archive/**"], ["we ird  "], ["*.l[o]g"],
         ["docs/**"], ["/docs/a/"], ["*"], ["lib/[]x].md"], ["ä/*"], ["a*/**/top.md"]]
NAME_PATTERNS = ["*.md", "README.md", "!README.md", "docs/*.md", "docs/**", "**/x.md", "a?c.md",
                 "/top.md", "archive/", "*/archive/", "[ab]*.md", "[!a]*.md", "lib/*", "lib/[x].md",
                 "*", "**", "save/*/c", "[z-a].md", "lib/[[]x].md", "./top.md", "[]", "lib/a b"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    made = []
    for path in PATHS:
        target = root / path
        if any((root / parent).is_file() for parent in PurePosixPath(path).parents):
            continue
        if target.exists():
            continue
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(path)
        made.append(path)
    return root, made


def git_ignored(root, paths):
    done = subprocess.run(["git", "check-ignore", "--no-index", "--stdin", "-z"], cwd=root,
                          input="\0".join(paths).encode(), capture_output=True)
    return set(filter(None, done.stdout.decode().split("\0")))


def test_wildmatch_agrees_with_git(column, tree, tmp_path):
    root, paths = tree
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    for rules in RULES:
        (root / ".gitignore").write_text("\n".join(rules) + "\n")
        want = git_ignored(root, paths)
        got = column(lambda c: r.ignored_wildmatch(c, rules), paths)  # noqa: B023
        assert {p for p, hit in zip(paths, got) if hit} == want, rules
    (root / ".gitignore").unlink()


def test_names_agree_with_the_standard_library(column):
    for pattern in NAME_PATTERNS:
        want = [fnmatch.fnmatchcase(PurePosixPath(p).name, pattern)
                or PurePosixPath(p).match(pattern) for p in PATHS]
        assert column(lambda c: r.ignored_by_name(c, [pattern]), PATHS) == want, pattern  # noqa: B023


def test_substring(column):
    for pattern in ["*.md", "docs", "a/*", "archive/", "[x]"]:
        want = [fnmatch.fnmatchcase(p, pattern) or pattern in p for p in PATHS]
        got = column(lambda c: r.ignored_by_substring(c, [pattern]), PATHS)  # noqa: B023
        assert got == want, pattern


def test_compat_and_strict(column):
    rules = ["*.md", "!README.md"]
    paths = ["README.md", "x.md", "x.py"]
    assert column(lambda c: r.is_ignored(c, rules), paths) == [True, True, False]
    assert column(lambda c: r.is_ignored(c, rules, "strict"), paths) == [False, True, False]
    assert column(lambda c: r.is_ignored(c, []), paths) == [False] * 3


def test_discovery_agrees_with_rglob(spark, tree):
    root, _ = tree
    files = read_files(spark, str(root)).where("path not like '.git/%'")
    for pattern in ["./*.md", "**/docs/**/*.md", "*.md", "docs/*.md", "**/*.md", "save/**/c",
                    "[ab]*.md", "**/a/**/x.md", "*/x.md"]:
        want = {str(f.relative_to(root)) for f in Path(root).rglob(pattern)
                if f.is_file() and ".git/" not in str(f)}
        got = [row["path"] for row in scan_patterns(files, [pattern]).select("path").collect()]
        assert sorted(got) == sorted(want), pattern
    both = scan_patterns(files, ["*.md", "docs/*.md"]).select("path").collect()
    assert len(both) == len(set(both))
    only = scan_patterns(files, ["./*.md"], root_only=True).select("path").collect()
    assert {row["path"] for row in only} == {"top.md", "abc.md", "a.c.md", "README.md"}


def test_folder_scans(spark):
    files = spark.createDataFrame(
        [("roles/a/tasks/m.yml",), ("roles/x.md",), ("roles/b/y.md",), ("roles/a/z",), ("r.md",)],
        "path string")
    assert {r_["role"] for r_ in scan_roles(files).collect()} == {"a", "b"}
    assert {r_["path"] for r_ in scan_docs(files, "roles", False).collect()} == {"roles/x.md"}
    assert scan_docs(files).count() == 3


def test_output_trees(column):
    paths = ["wiki/a.md", "docs/wiki/a.md", "wikis/a.md", ".wiki/raw/x", "a/wiki", "wiki.md"]
    assert column(lambda c: r.in_output_trees(c, [".wiki", "wiki"]), paths) == [
        True, True, False, True, True, False]


def test_gitrules_agree_with_git(spark, tmp_path):
    files = {"": ["*.log", "!keep.log", "/build/", "tmp*"], "sub": ["!a.log", "inner/x.md"],
             "sub/inner": ["*.md", "!y.md"]}
    paths = ["a.log", "keep.log", "sub/a.log", "sub/b.log", "sub/inner/x.md", "sub/inner/y.md",
             "sub/inner/z.md", "build/o", "sub/build/o", "sub/tmp1", "x.md", "sub/keep.log"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for path in paths:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    for base, lines in files.items():
        (tmp_path / base / ".gitignore").write_text("\n".join(lines) + "\n")
    rules = spark.createDataFrame(
        [(base, i, line) for base, lines in files.items() for i, line in enumerate(lines)],
        "base_dir string, seq int, pattern string")
    rows = spark.createDataFrame([(p, p == "a.log") for p in paths], "path string, tracked boolean")
    got = {x["path"] for x in ignored_by_gitrules(rows, rules).where("ignored").collect()}
    assert got == git_ignored(tmp_path, paths) - {"a.log"}


def test_rule_table_equals_inline_rules(spark):
    patterns = list(itertools.chain(*RULES[:13], ["a?c*", "!*b*", "docs/?/x.md"], ["!docs/a/"],
                                    ["[l]ib/?.md", "!lib/[x-y].m?", None, "?*\\!*", "!*a?g"]))
    rules = spark.createDataFrame(list(enumerate(patterns)), "seq int, pattern string")
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    want = paths.where(~r.ignored_wildmatch(F.col("path"), [p for p in patterns if p])).collect()
    got = rule_antijoin(paths, rules).select("path").collect()
    assert sorted(got) == sorted(want)


def test_nameless_rules_are_found_by_rare_text(spark):
    patterns = [f"run?{i:05d}*" for i in range(20_000)] + ["!run?00007*", "no?such*text"]
    rules = spark.createDataFrame(list(enumerate(patterns)), "seq int, pattern string")
    paths = spark.createDataFrame([(f"d/run_{i:05d}.md",) for i in range(19_990, 20_010)]
                                  + [("d/run_00007.md",), ("d/run.md",), ("e",)], "path string")
    got = {x["path"] for x in rule_antijoin(paths, rules).collect()}
    assert got == {f"d/run_{i:05d}.md" for i in range(20_000, 20_010)} | {
        "d/run_00007.md", "d/run.md", "e"}
    # joined rows are few: a path meets the rules that have its own digits
    met = nameless_candidates(paths, compile_rules(rules).where("token is null"))
    assert met.count() <= 2 * paths.count()

    def expressions(n):
        some = rules.where(F.col("seq") < n)
        return rule_antijoin(paths, some)._jdf.queryExecution().optimizedPlan().toString().count("rlike")

    assert expressions(10) == expressions(2000)


def test_rules_of_any_length_are_taken(spark):
    rules = spark.range(2).selectExpr("id seq", "concat('?', repeat('a', 3000 + id)) pattern")
    paths = spark.createDataFrame([("ba",), ("a" * 3001,), ("b" + "a" * 3000,)],
                                  "path string")
    assert [x["path"] for x in rule_antijoin(paths, rules).collect()] == ["ba"]


def test_no_rules_keep_all(spark):
    paths = spark.createDataFrame([("a",), ("b/c",)], "path string")
    for lines in ([], ["", "# note", None]):
        rules = spark.createDataFrame(list(enumerate(lines)), "seq int, pattern string")
        assert rule_antijoin(paths, rules).count() == 2
        files = rules.withColumn("base_dir", F.lit(""))
        flagged = paths.withColumn("tracked", F.lit(False))
        assert ignored_by_gitrules(flagged, files).where("ignored").count() == 0


def test_rule_files_are_indexed_not_tried(spark):
    """Rule files in every dialect, met in parts of a few paths, against the same rules inline."""
    files = [*RULES, list(itertools.chain(*RULES[:13], ["!docs/a/", "?.md", "!lib/[!x]?md"]))]
    rules = spark.createDataFrame(
        [(f"r{k}", i, p) for k, lines in enumerate(files) for i, p in enumerate(lines)],
        "base_dir string, seq int, pattern string")
    paths = spark.createDataFrame([(f"r{k}/{p}", False) for k in range(len(files)) for p in PATHS],
                                  "path string, tracked boolean")
    flagged = ignored_by_gitrules(paths, rules, group_paths=4)
    inline = spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", *[
        r.ignored_wildmatch(F.col("path"), lines).alias(f"r{k}") for k, lines in enumerate(files)])
    want = {f"r{k}/{row['path']}" for row in inline.collect() for k in range(len(files))
            if row[f"r{k}"]}
    assert {row["path"] for row in flagged.where("ignored").collect()} == want
    assert "rlike" not in flagged._jdf.queryExecution().executedPlan().toString().lower()


def test_a_long_rule_file_costs_little_more_than_a_short_one():
    def rules(n):
        kinds = ["name{}.md", "*.e{}", "dir{}/", "/a/run?{}*", "x*{}?y", "!name{}.md"]
        return [r.wildmatch_rule(kinds[i % len(kinds)].format(i)) for i in range(n)]

    paths = [f"a/run_{i}/name{i}.md" for i in range(30_000)]

    def seconds(n):
        best = 1e9
        for _ in range(3):
            found = RuleSet(rules(n))
            began = time.perf_counter()
            for path in paths:
                found.verdict(path)
            best = min(best, time.perf_counter() - began)
        return best

    many = RuleSet(rules(5000))
    assert max(len(many.candidates(p)) for p in paths[::100]) <= 30
    assert seconds(5000) < 2 * seconds(50) + 0.5  # half a second for what the machine does besides
