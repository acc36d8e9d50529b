import itertools
import os
from pathlib import PurePosixPath

import yaml
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import paths as p
from corpusmill.functions import text as x

PATHS = ["roles/r1/tasks/main.yml", "x/roles/r2/a.yml", "roles/z", "q/roles", "a/b/c.yml",
         "x.yml", "roles", "a.b.md", "d/.md", "d/..a", "d/a.", "d/a.b.", "d/-x.tar.gz",
         "a/b.md", "a-b.md", "a.md", "é/ü.md", "roles/roles/x"]
CHARS = "a#B \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　﻿-é2_"
strings = st.lists(st.text(alphabet=CHARS, max_size=24), min_size=60, max_size=60)
few = settings(max_examples=4, deadline=None)


def python_role(path):
    parts = PurePosixPath(path).parts
    if "roles" in parts and parts.index("roles") + 1 < len(parts):
        return parts[parts.index("roles") + 1]
    return PurePosixPath(path).parent.name


def test_role_name(column):
    assert column(p.role_name, PATHS) == [python_role(v) for v in PATHS]


def test_path_stem(column):
    assert column(p.path_stem, PATHS) == [PurePosixPath(v).stem for v in PATHS]


def test_path_order(spark):
    df = spark.createDataFrame([(v,) for v in PATHS], "path string")
    got = [r[0] for r in df.orderBy(p.components(F.col("path"))).collect()]
    assert got == [str(v) for v in sorted(map(PurePosixPath, PATHS))]


def test_relative_link(column):
    pairs = list(itertools.product(
        ["a/b.md", "a/b/c/d.md", "x.md", "a", "a/b", "e/f"], ["a/b.md", "i.md", "a/b/c/z.md"]))
    want = [os.path.relpath("/" + t, os.path.dirname("/" + f)) for t, f in pairs]
    assert column(p.relative_link, pairs) == want


def test_rel_path(column):
    full = ["file:/data/t/a/b.md", "hdfs://host:9000/data/t/a/b.md", "/data/t/a/b.md"]
    for root in ("/data/t", "/data/t/", "file:/data/t", "hdfs://host:9000/data/t"):
        assert column(lambda c: p.rel_path(c, root), full) == ["a/b.md"] * 3  # noqa: B023


def python_compact(text, joiner="\n", strip=False):
    kept = [part for part in text.splitlines()
            if part.strip() and not part.strip().startswith("#")]
    return joiner.join(part.strip() if strip else part for part in kept)


def test_line_functions(column):
    @few
    @given(strings)
    def check(values):
        assert column(x.compact_lines, values) == [python_compact(v) for v in values]
        assert column(x.squeeze_lines, values) == [python_compact(v, "", True) for v in values]
        assert column(x.strip, values) == [v.strip() for v in values]

    check()


def test_every_space_is_stripped(column):
    values = [chr(c) + "x" + chr(c) for c in range(1, 0x3100)]
    assert column(x.strip, values) == [v.strip() for v in values]


def test_title_case(column):
    @few
    @given(st.lists(st.text(alphabet="aZé_2-' 中ª", max_size=12), min_size=60, max_size=60))
    def check(values):
        assert column(x.title_case, values) == [v.replace("_", " ").title() for v in values]

    check()
    assert column(x.title_case, ["my-role_2fa", "éclair_ünder"]) == ["My-Role 2Fa", "Éclair Ünder"]
    odd = ["ßa", "ǆx", "ﬁn_ﬂy", "აბ", "ŉa", "x ᾳb"]  # title case is not upper case
    assert column(x.title_case, odd) == [v.replace("_", " ").title() for v in odd]


def test_decode(column):
    values = [b"a\r\nb\rc\n", "é ".encode(), b"\xff\xfe", b"", b"\xef\xbb\xbf---"]
    got = column(x.decode_text, values, kind="binary")
    assert got == ["a\nb\nc\n", "é ", None, "", "﻿---"]


def test_truncate(column):
    values = ["x" * n for n in (0, 10, 20, 21, 40)] + ["é" * 21]
    want = [v if len(v) <= 20 else v[:10] + "\n... [truncated - large file] ..." for v in values]
    assert column(lambda c: x.truncate_text(c, 10), values) == want


def test_findings(column):
    values = ["An ISSUE", "nothing", "MisSing x", "I Suggest", "", None]
    assert column(x.is_finding, values) == [True, False, True, True, False, None]


def test_yaml_string(column):
    values = ["a/b.md", "docs/a b.md", "- a", "-a", "a: b", "a:b", "a #b", "a#b", "#a", "'q'", "1",
              "0x1f", "1.5", "1e3", "1.5e+3", "true", "Yes", "on", "null", "~", "", " a", "a ",
              "2025-01-01", "2025-01-01T00:00:00+00:00", "12:30", "@a", "`a", "%a", "!a", "&a",
              "*a", "[a", "]a", "{a", "}a", ",a", "?a", "? a", ":a", "|a", ">a", "a]", "a,b", "=",
              "---", "...", ".inf", ".5", "1_000", "é/ü.md", "a'b", 'a"b', "<<", "0o7", "010", "+1",
              "a:", "-", "?", ":", "--- x", ".nan", "1.", "09"]
    words = "some longer words in the name of a directory/"
    values += [words * 2, words * 3, words * 8 + "a.md", "- " + words * 5, "it's #1: " + words * 4,
               "x" * 100 + " y", "x" * 100 + "  y z", words * 2 + " " * 3 + words * 3, "a\ab\nc.md",
               "a\nb.md", "a\n\nb's", "tab\tname", "nul\x00", "\x1b[0m \\ \"q\"", "a \nb", "a\n b",
               "\x7f", "\x9f\x85", "\ufeffa", "a\n" + words * 4, words * 3 + "\n" + words * 4]
    want = [yaml.safe_dump({"k": v}, allow_unicode=True)[3:].removesuffix("\n") for v in values]
    got = column(lambda c: x.yaml_string(c, 3), values)
    assert [w for w, g in zip(want, got) if w != g] == []
    assert [yaml.safe_load("k: " + g)["k"] for g in got] == values


def test_frontmatter(column):
    texts = ["body\n", "  lead", "---\na: 1\n---\nx", "", "end  　"]
    meta = {"original_path": "docs/a.md", "harvested_date": "2025-01-01T00:00:00+00:00",
            "source_type": "legacy_markdown"}
    head = yaml.safe_dump(meta, allow_unicode=True).strip()
    want = [f"---\n{head}\n---\n\n{t}".strip() for t in texts]
    got = column(lambda c: x.add_frontmatter(c, {k: F.lit(v) for k, v in meta.items()}), texts)
    assert got == want


def test_ensure_frontmatter(column):
    header = ('---\ntitle: "My Role Role"\nrole: roles/my_role\ncategory: Roles\n'
              "type: ansible-role\ntags: [ansible, role, my_role]\n---\n\n")
    texts = ["text", " \n---\nx", "﻿---", "--", "　---"]
    got = column(lambda c: x.ensure_frontmatter(c, F.lit("my_role"), F.lit("roles/my_role")), texts)
    assert got == [t if t.strip().startswith("---") else header + t for t in texts]


def test_prompts_take_missing_parts(column):
    assert column(lambda c: x.compile_prompt(c, None), ["t"]) == ["\n\nOriginal content:\nt\n\n"]
    assert column(lambda c: x.lint_prompt(F.lit("w/p"), c, {"prefix": None, "suffix": "S"}),
                  ["t"]) == ["\n\nFile: w/p\n\nContent:\nt\n\nS"]
    assert column(lambda c: x.role_prompt(F.lit("r/x"), c, {"prefix": "P"}), ["s"]) == [
        "P\nRole Path: r/x\n\ns\n\n"]
