import hashlib
import random
import time
import tracemalloc
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from corpusmill import storage
from corpusmill.checks.tables import flaky_model
from corpusmill.functions.text import truncate_text
from corpusmill.operators import fingerprints as fp
from corpusmill.operators import media, ordering, pages, rollup
from corpusmill.operators.changes import changed_only, split_outcomes, state_of
from corpusmill.operators.model import call_model, until_successes
from corpusmill.operators.ordering import first_rows
from corpusmill.operators.pages import ordered_pages
from corpusmill.plans.ingest import member_texts
from corpusmill.sources.state import STATE_SCHEMA, load_state
from corpusmill.sources.tables import KeyedTable

TREE = {
    "r1": {"tasks/main.yml": b"# c\n  a: 1 \n\n\tb: 2\n", "a/b.md": b"1", "a-b.md": b"2",
           "a.md": b"\xff\xfe\x00", "defaults/main.yml": b"x: y\r\nz: 1"},
    "r2": {"meta/main.yml": b"m: 1\n", "q": b""},
    "r3": {"other": b"o"},
}


def files(spark, tree=TREE):
    rows = [(role, rel, bytearray(data)) for role, members in tree.items()
            for rel, data in members.items()]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "role string, rel string, content binary").repartition(3)


def prints(df):
    return {r["role"]: r["fingerprint"] for r in df.collect()}


def test_group_fingerprint_is_the_tree_over_file_hashes(spark):
    hashed = files(spark).withColumn("h", fp.file_fingerprint(F.col("content")))
    assert prints(fp.group_fingerprint(files(spark), "role", "rel", "content")) == prints(
        fp.merkle_fingerprint(hashed, "role", "rel", "h"))


@pytest.mark.parametrize("role,rel", [("r1", "a/b.md"), ("r2", "q"), ("r3", "other")])
def test_one_byte_changes_one_group(spark, role, rel):
    changed = {k: dict(v) for k, v in TREE.items()}
    changed[role][rel] += b"!"
    for make in (
        lambda f: fp.merkle_fingerprint(
            f.withColumn("h", fp.file_fingerprint(F.col("content"))), "role", "rel", "h"),
        lambda f: fp.group_fingerprint(f, "role", "rel", "content"),
    ):
        before, after = prints(make(files(spark))), prints(make(files(spark, changed)))
        assert {k for k in before if before[k] != after[k]} == {role}


def test_compact_fingerprint(spark):
    def python(members):
        text = ""
        for name in ("tasks/main.yml", "defaults/main.yml", "meta/main.yml"):
            for line in members.get(name, b"").decode().splitlines():
                if line.strip() and not line.strip().startswith("#"):
                    text += line.strip()
        return hashlib.md5(text.encode()).hexdigest()

    got = prints(fp.compact_fingerprint(files(spark), "role", "rel", "content"))
    assert got == {role: python(members) for role, members in TREE.items()}


def python_pages(items, sep, size):
    pages, start = {}, 0
    for text in items:
        pages.setdefault(start // size, []).append(text)
        start += len(text) + len(sep)
    return {n: sep.join(texts) for n, texts in pages.items()}


@pytest.mark.parametrize("size,sep,borders", [
    (10, "\n", 1000), (60, "\n\n", 1000), (10_000, "", 1000), (3, "", 1000), (10, "", 7), (60, "", 1)])
def test_pages_split_only_what_does_not_fit(spark, size, sep, borders):
    rng = random.Random(size)
    groups = {"hot": 400, "warm": 30, "one": 1}  # the hot group holds most rows
    rows = [(g, [f"{i // 10:03d}", f"{i % 10}"], "x" * rng.randint(0, 9) + f"é{i}")
            for g, n in groups.items() for i in range(n)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "g string, k array<string>, t string").repartition(5)
    got = {(r["g"], r["page"]): r["t"] for r in
           ordered_pages(df, ["g"], "k", "t", sep, size, borders).collect()}
    want = {}
    for g in groups:
        texts = [t for h, _, t in sorted(rows, key=lambda r: r[:2]) if h == g]
        want.update({(g, n): t for n, t in python_pages(texts, sep, size).items()})
    assert got == want


def test_texts_of_pages_are_written_once_and_shuffled_once(spark, monkeypatch):
    written = []

    def recorded(df, label, *more, **named):
        written.append((label, df.columns))
        return storage.materialise(df, label, *more, **named)

    monkeypatch.setattr(pages, "materialise", recorded)
    monkeypatch.setattr(ordering, "materialise", recorded)
    rows = spark.range(500).select(F.lit("g").alias("g"), F.format_string("%05d", "id").alias("k"),
                                   F.lit("some text").alias("t"))
    found = pages.ordered_pages(rows, ["g"], "k", "t", "\n", 100)
    assert found.count() == 50
    assert [label for label, columns in written if "t" in columns] == ["pages"]
    assert "ranges" in [label for label, _ in written]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange range" not in plan


def test_members_and_sections(spark):
    tree = [("roles/r/tasks/a/m.yml", b"first: 1\n# no\n"), ("roles/r/tasks/b/m.yml", b"last: 2"),
            ("roles/r/defaults/z.yaml", b"z: 1"), ("roles/r/defaults/y.yml", b"y: 1"),
            ("roles/r/meta/bad.yml", b"\xff"), ("roles/r/vars/v.yml", b"v: 1"),
            ("roles/r/tasks/x.txt", b"t"), ("roles/r/tasks.yml", b"t"), ("x/roles/r/tasks/q.yml", b"q")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in tree], "path string, content binary")
    got = rollup.role_sections(member_texts(rollup.role_members(df))).collect()
    assert [(r["role"], r["page"]) for r in got] == [("r", 0)]
    assert got[0]["sections"] == "\n\n".join(
        f"### {k}\n```yaml\n{v}\n```" for k, v in
        [("defaults/y.yml", "y: 1"), ("defaults/z.yaml", "z: 1"), ("tasks/m.yml", "last: 2")])


def test_categories(spark):
    config = {"net_work": {"roles": ["a", "b", "gone", "a"]}, "other": {"description": "rest",
              "title": "Unused"}, "z": {"title": "Zed", "roles": ["b"]}, "empty": {"roles": ["gone"]}}
    active = spark.createDataFrame([("a",), ("b",), ("c",), ("c1",)], "role string")
    listed = rollup.category_table(spark, config)
    assigned = rollup.category_assign(listed, active)
    everything = rollup.assignment_union(assigned, rollup.category_default(active, assigned))
    titles = rollup.category_titles(everything, listed)
    rows = {r["cat"]: (r["title"], r["description"], r["links"])
            for r in rollup.category_rollup(everything, titles).collect()}
    line = "- [{0}](roles/{0}.md)".format
    assert rows == {
        "net_work": ("Net Work", "", "\n".join(map(line, "aab"))),
        "other": ("Other Roles", "rest", line("c") + "\n" + line("c1")),
        "z": ("Zed", "", line("b"))}
    priority = spark.createDataFrame([(0, "c"), (1, "nope"), (2, "a")], "pos int, role string")
    index = rollup.index_document(spark, everything, titles,
                                  rollup.priority_roles(priority, active), "T", "S", "D").collect()
    assert [r["page"] for r in index] == [0]
    assert index[0]["text"] == (
        "# T\n\nS\n\nD\n\n## Priority Roles\n\n- **[c](roles/c.md)** — Core role\n"
        "- **[a](roles/a.md)** — Core role\n\n## All Roles by Category\n\n"
        f"### Net Work\n\n{line('a')}\n{line('a')}\n{line('b')}\n\n"
        f"### Other Roles\n*rest*\n\n{line('c')}\n{line('c1')}\n\n### Zed\n\n{line('b')}\n\n")


def test_reports(spark):
    found = spark.createDataFrame([("a-b.md", "2"), ("a/b.md", "1"), ("a.md", "3")],
                                  "file_id string, finding string")
    assert [tuple(r) for r in rollup.lint_report(found).collect()] == [
        (0, "# Wiki Lint Report\n\n1\n\n2\n\n3")]
    assert [tuple(r) for r in rollup.lint_report(found.where("false")).collect()] == [
        (0, "# Wiki Lint Report\n\nNo major issues found.")]


def test_media_section_is_replaced_not_repeated(spark):
    assets = spark.createDataFrame([("b", "media/b.png"), ("a", "media/a/a.png")],
                                   "stem string, link string")
    section = rollup.media_section(assets)
    want = "\n## 📊 System Visuals & Charts\n\n- [a](media/a/a.png)\n- [b](media/b.png)"
    assert [tuple(r) for r in section.collect()] == [(0, want)]
    docs = spark.createDataFrame([("index.md", "# I\n"), ("x.md", "x")], "path string, text string")
    once = media.append_section(docs, section)
    assert [tuple(r) for r in once.collect()] == [("index.md", "# I\n" + want)]
    assert media.append_section(once, section).collect() == once.collect()
    assert media.append_section(docs.where("path = 'x.md'"), section).count() == 0


def test_state_files(spark, tmp_path):
    def load(text=None):
        path = tmp_path / "state.json"
        if text is not None:
            path.write_text(text)
        return sorted(map(tuple, load_state(spark, str(path)).collect()))

    assert load() == []
    assert load('{"harvest": {"a": "1", "b": "2"}, "lint": {}}') == [
        ("harvest", "a", "1"), ("harvest", "b", "2")]
    assert load("{bad") == []
    assert load("") == []


def test_changed_only_and_upsert(spark, tmp_path):
    state = spark.createDataFrame(
        [("s", "same", "1"), ("s", "old", "1"), ("t", "new", "2")],
        "stage string, file_id string, hash string")
    current = spark.createDataFrame([("same", "1"), ("old", "2"), ("new", "2")],
                                    "file_id string, hash string")
    changed = changed_only(current, state, "s")
    assert {r["file_id"] for r in changed.collect()} == {"old", "new"}
    failed = changed.withColumn("error", F.when(F.col("file_id") == "new", "x"))
    done, bad = split_outcomes(failed)
    assert [r["file_id"] for r in bad.collect()] == ["new"]
    table = KeyedTable(spark, str(tmp_path / "state"), ["stage", "file_id"], STATE_SCHEMA)
    table.apply(state)
    table.apply(state_of(done, "s"))
    saved = table.read()
    assert changed_only(current, saved, "s").select("file_id").collect()[0][0] == "new"
    rows = sorted(map(tuple, saved.collect()))
    table.apply(state_of(done, "s"))
    assert sorted(map(tuple, table.read().collect())) == rows


def outcomes_model():
    def make():
        def answer(messages, **params):
            assert messages[0]["role"] == "user" and params["max_tokens"] == 7
            text = messages[0]["content"]
            if text.startswith("bad"):
                raise RuntimeError(text)
            return f"  {text}　\n"
        return answer
    return make


def test_model_rows_fail_alone(spark):
    prompts = spark.createDataFrame([("a", "ok", 1), ("b", "bad one", 2)],
                                    "file_id string, prompt string, extra long")
    got = {r["file_id"]: tuple(r)[1:] for r in call_model(
        prompts, outcomes_model(), {"max_tokens": 7}, attempts=3, delay=0, parallelism=2).collect()}
    assert got == {"a": (1, "ok", None, 1), "b": (2, None, "RuntimeError: bad one", 3)}


def test_calls_in_flight_keep_their_rows(spark):
    def make():
        return lambda messages, **params: (time.sleep(0.3), messages[0]["content"].upper())[1]

    prompts = spark.createDataFrame([(f"f{i}", f"p{i}") for i in range(16)],
                                    "file_id string, prompt string").coalesce(1)
    begin = time.time()
    got = call_model(prompts, make, in_flight=16).collect()
    assert time.time() - begin < 16 * 0.3 + 2
    assert {r["file_id"]: r["response"] for r in got} == {f"f{i}": f"P{i}" for i in range(16)}


def test_calls_keep_all_columns_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr("corpusmill.operators.model.CALL_ROWS", 7)
    rows = spark.range(100, numPartitions=2).select(
        F.expr("if(id % 3 = 0, null, id)").alias("a b"), F.array("id").alias("list"),
        F.expr("named_struct('x', id, 'day', date'2024-01-01')").alias("pair"),
        F.expr("if(id % 10 = 0, null, 'p' || id)").alias("prompt"))
    got = call_model(rows, lambda: lambda messages, **params: messages[0]["content"] + "!")
    assert got.schema.fieldNames() == ["a b", "list", "pair", "response", "error", "attempts"]
    for r in got.collect():
        i = r["pair"]["x"]
        assert r["a b"] == (None if i % 3 == 0 else i) and r["list"] == [i]
        assert r["response"] == (None if i % 10 == 0 else f"p{i}!") and r["attempts"] == 1
        assert (r["error"] or "").startswith("TypeError") == (i % 10 == 0)
    assert got.count() == 100


def test_the_flaky_model_keeps_no_prompts():
    answer = flaky_model()()
    tracemalloc.start()
    for i in range(2000):
        prompt = f"{i:06d}" + "x" * (4000 + i % 7)
        calls = 0
        while True:
            calls += 1
            try:
                text = answer([{"role": "user", "content": prompt}])
                break
            except TimeoutError:
                pass
        assert (text, calls) == (f"done {len(prompt)}", len(prompt) % 7 + 1)
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("limit,failing,top", [
    (None, "some", 100), (0, "all", 100), (1, "some", 100), (5, "none", 100), (5, "some", 100),
    (17, "some", 100), (5, "all", 100), (100, "some", 100), (5, "some", 2), (17, "none", 2),
    (40, "all", 2), (17, "some", 2)])
def test_limit_counts_successes_in_path_order(spark, monkeypatch, limit, failing, top):
    monkeypatch.setattr("corpusmill.operators.ordering.RANGE_ROWS", top)
    ids = ["a/b.md", "a-b.md", "a.md"] + [f"d{i % 3}/f{i:02d}.md" for i in range(30)]
    fails = {"none": set(), "some": set(ids[::2]), "all": set(ids)}[failing]
    want, successes = [], 0
    for name in sorted(ids, key=PurePosixPath):
        if limit and successes >= limit:
            break
        want.append(name)
        successes += name not in fails
    df = spark.createDataFrame([(i,) for i in ids], "file_id string").repartition(3)

    def run(batch):
        return batch.withColumn("error", F.when(F.col("file_id").isin(list(fails)), "x"))

    got = [r["file_id"] for r in until_successes(df, limit, run).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("top", [3, 100])
def test_first_rows(spark, monkeypatch, top):
    monkeypatch.setattr("corpusmill.operators.ordering.RANGE_ROWS", top)
    df = spark.range(50).selectExpr("(id * 7) % 50 as k").repartition(4)
    first = first_rows(df, "k", 20)
    assert sorted(r["k"] for r in first.collect()) == list(range(20))
    assert "TakeOrdered" not in first._jdf.queryExecution().executedPlan().toString()
    assert first_rows(df, "k", 0).count() == 0 and first_rows(df, "k", 99).count() == 50


def test_limit_over_nothing(spark):
    df = spark.createDataFrame([], "file_id string")
    assert until_successes(df, 3, lambda b: b.withColumn("error", F.lit("x"))).count() == 0


def test_truncation_is_counted_in_characters(spark):
    df = spark.createDataFrame([("😀" * 21,)], "t string")
    assert df.select(truncate_text(F.col("t"), 10)).first()[0].startswith("😀" * 10 + "\n...")
