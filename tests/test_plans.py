import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusmill.plans.compile import compile_docs
from corpusmill.plans.config import load_config
from corpusmill.plans.converge import converge, summary
from corpusmill.plans.harvest import harvest
from corpusmill.plans.index import index_files, write_index
from corpusmill.plans.ingest import ingest
from corpusmill.plans.lint import lint_docs
from corpusmill.plans.workspace import Model, Workspace, run_counts
from corpusmill.storage import observed

DATE, LATER = "2025-01-01T00:00:00+00:00", "2025-02-02T00:00:00+00:00"
TREE = {
    "README.md": "top", "docs/a.md": "alpha", "docs/b/index.md": "b", "archive/old.md": "old",
    "docs/wiki/no.md": "output", ".wiki/raw/x.md": "state", "tests/t.md": "test", "notes.txt": "n",
    "roles/web/tasks/main.yml": "- a: 1", "roles/web/README.md": "web docs",
    "roles/db/defaults/main.yml": "x: 1\n# c", "roles/my_app/files/f": "f",
}


def tree(spark, **changes):
    rows = {**TREE, **changes}
    return spark.createDataFrame(
        [(p, bytearray(t if isinstance(t, bytes) else t.encode()))
         for p, t in rows.items() if t is not None], "path string, content binary")


def echo(fail=()):
    """Answers with the prompt; fails on prompts that contain one of ``fail``."""
    def make():
        def answer(messages, **params):
            text = messages[0]["content"]
            for word in fail:
                if word in text:
                    raise RuntimeError(word)
            return f"ISSUE <{text}>"
        return answer
    return Model(make)


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "ws"))


def texts(table):
    return {r["path"]: r["text"] for r in table.read().collect()}


def ids(outcomes):
    return {r["file_id"] for r in outcomes.collect()}


def state(ws, stage):
    return {r["file_id"]: r["hash"] for r in ws.state.read().where(F.col("stage") == stage).collect()}


def header(path, text, date=DATE):
    return (f"---\nharvested_date: '{date}'\noriginal_path: {path}\n"
            f"source_type: legacy_markdown\n---\n\n{text}")


FOUND = {"README.md", "docs/a.md", "docs/b/index.md", "roles/web/README.md"}


def test_harvest_stages_and_then_skips(spark, ws):
    config = load_config()
    assert ids(harvest(ws, tree(spark), config, DATE)) == FOUND
    assert texts(ws.raw) == {p: header(p, TREE[p]) for p in FOUND}
    assert set(state(ws, "harvest")) == FOUND
    assert ids(harvest(ws, tree(spark), config, LATER, changed_only=True)) == set()
    changed = tree(spark, **{"docs/a.md": "alpha!"})
    assert ids(harvest(ws, changed, config, LATER, changed_only=True)) == {"docs/a.md"}
    assert texts(ws.raw)["docs/a.md"] == header("docs/a.md", "alpha!", LATER)
    assert texts(ws.raw)["README.md"] == header("README.md", "top")
    assert ids(harvest(ws, tree(spark), config, DATE)) == FOUND  # off by default: all pass


def test_harvest_cleans_up(spark, ws):
    harvest(ws, tree(spark), load_config(), DATE)
    ignoring = load_config({"wiki": {"harvest_ignore": ["docs/b/"]}})
    harvest(ws, tree(spark, **{"README.md": None}), ignoring, DATE, changed_only=True)
    kept = (FOUND - {"README.md", "docs/b/index.md"}) | {"archive/old.md", "tests/t.md"}
    assert set(texts(ws.raw)) == kept and set(state(ws, "harvest")) == kept
    # back again: its hash was dropped with it, so it is staged
    assert ids(harvest(ws, tree(spark), load_config(), DATE, changed_only=True)) == {
        "README.md", "docs/b/index.md"}


def test_harvest_can_keep_deleted(spark, ws):
    harvest(ws, tree(spark), load_config(), DATE)
    harvest(ws, tree(spark, **{"README.md": None}), load_config(
        {"wiki": {"harvest_ignore": ["docs/b/"]}}), DATE, changed_only=True, keep_deleted=True)
    assert "README.md" in texts(ws.raw) and "docs/b/index.md" not in texts(ws.raw)
    assert "docs/b/index.md" in state(ws, "harvest")


def test_harvest_limit_and_bad_bytes(spark, ws):
    files = tree(spark, **{"README.md": b"\xff", "a.md": b"\xfe"})
    done = harvest(ws, files, load_config(), DATE, limit=2)
    assert ids(done) == {"docs/a.md", "docs/b/index.md"} == set(texts(ws.raw))
    bad = spark.read.parquet(f"{ws.root}/quarantine")
    assert {(r["stage"], r["file_id"], r["error"]) for r in bad.collect()} == {
        ("harvest", "README.md", "not UTF-8"), ("harvest", "a.md", "not UTF-8")}
    full = harvest(ws, files, load_config(), DATE)
    assert ids(full) == FOUND - {"README.md"}


def test_harvest_of_nothing_and_of_bad_bytes_only(spark, ws):
    config = load_config()
    none = tree(spark).where("false")
    assert ids(harvest(ws, none, config, DATE, changed_only=True)) == set()
    assert ids(harvest(ws, none, config, DATE)) == set() and texts(ws.raw) == {}
    bad = tree(spark, **{"docs/a.md": b"\xff"}).where("path = 'docs/a.md'")
    assert ids(harvest(ws, bad, config, DATE, changed_only=True)) == set()
    assert [r["file_id"] for r in spark.read.parquet(f"{ws.root}/quarantine").collect()] == [
        "docs/a.md"]


def test_harvest_respects_git_rules(spark, ws):
    rules = spark.createDataFrame([("", 0, "*.md"), ("docs", 0, "!a.md")],
                                  "base_dir string, seq int, pattern string")
    tracked = spark.createDataFrame([("README.md",)], "path string")
    assert ids(harvest(ws, tree(spark), load_config(), DATE, git_rules=rules, tracked=tracked)) == {
        "README.md", "docs/a.md"}


def test_compile_retries_failures_only(spark, ws):
    config = load_config()
    harvest(ws, tree(spark), config, DATE)
    first = compile_docs(ws, echo(fail=["alpha"]), config, changed_only=True)
    assert ids(first) == FOUND - {"docs/b/index.md"}
    assert set(texts(ws.wiki)) == {"README.md", "roles/web/README.md"}
    wanted = config["compile_prompt"]
    assert texts(ws.wiki)["README.md"] == (
        f"ISSUE <{wanted['prefix']}\n\nOriginal content:\n{header('README.md', 'top')}\n\n"
        f"{wanted['suffix']}>")
    assert ids(compile_docs(ws, echo(), config, changed_only=True)) == {"docs/a.md"}
    assert ids(compile_docs(ws, echo(), config, changed_only=True)) == set()
    harvest(ws, tree(spark), config, LATER)  # only the date in the header is new
    assert ids(compile_docs(ws, echo(), config, changed_only=True)) == set()
    assert ids(compile_docs(ws, echo(), config, changed_only=True, hash_header=True)) == \
        FOUND - {"docs/b/index.md"}


def counting(calls):
    """Answers like ``echo``, and leaves a file for every call."""
    def make():
        def answer(messages, **params):
            (calls / uuid.uuid4().hex).write_text(messages[0]["content"])
            return "ISSUE"
        return answer
    return Model(make, chunk_rows=2, parallelism=1)


@pytest.mark.parametrize("stage", ["compile", "lint", "ingest"])
def test_a_killed_run_keeps_the_chunks_it_paid_for(spark, ws, tmp_path, monkeypatch, stage):
    config, calls = load_config(), tmp_path / "calls"
    calls.mkdir()
    docs = spark.createDataFrame([(f"d{i}.md", f"text {i}", str(i)) for i in range(5)],
                                 "path string, text string, source_hash string")
    ws.raw.apply(docs)
    ws.wiki.apply(docs.select("path", "text"))
    files = spark.createDataFrame([(f"roles/r{i}/tasks/main.yml", bytearray(b"- a: 1"))
                                   for i in range(5)], "path string, content binary")
    run = {"compile": lambda: compile_docs(ws, counting(calls), config, changed_only=True),
           "lint": lambda: lint_docs(ws, counting(calls), config, changed_only=True),
           "ingest": lambda: ingest(ws, files, counting(calls), config, changed_only=True)}[stage]
    saved = ws.state.apply

    def dies(*args, batch=0, **kwargs):
        if batch == 1:
            raise RuntimeError("killed")
        return saved(*args, batch=batch, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(ws.state, "apply", dies)
        with pytest.raises(StreamingQueryException):
            run()
    kept, asked = set(state(ws, stage)), len(list(calls.iterdir()))
    assert 1 <= len(kept) < asked < 5  # two chunks were asked, one was saved
    done = run()
    assert ids(done) == {f"d{i}.md" if stage != "ingest" else f"r{i}" for i in range(5)} - kept
    assert len(list(calls.iterdir())) == asked + 5 - len(kept) and len(state(ws, stage)) == 5
    assert observed(done)["processed"] == 5 - len(kept)
    assert ids(run()) == set()


def test_runs_count_while_they_write(spark, ws):
    """Counters of a run equal a count of its outcomes, without another scan."""
    bad = tree(spark, **{"docs/a.md": b"\xff"})
    for only_changed in (False, True):
        outcomes = converge(ws, bad, echo(fail=["roles/db"]), load_config(), DATE,
                            changed_only=only_changed)
        counted = run_counts(outcomes)
        for row in summary(outcomes).collect():
            if row["stage"] in counted and row["outcome"] in ("processed", "failed"):
                assert counted[row["stage"]][row["outcome"]] == row["n"], row
        assert set(counted) >= {"harvest", "ingest", "compile", "lint"}


def test_lint_reports_this_run_and_keeps_findings(spark, ws):
    config = load_config({"wiki": {"lint_prompt": {"prefix": "P"}}})
    ws.wiki.apply(spark.createDataFrame([("a-b.md", "1"), ("a/b.md", "2"), ("lint-report.md", "x")],
                                        "path string, text string"))
    lint_docs(ws, echo(), config)
    answer = "ISSUE <P\n\nFile: wiki/{0}\n\nContent:\n{1}\n\n>".format
    assert ws.report().first()["text"] == (
        f"# Wiki Lint Report\n\n{answer('a/b.md', 2)}\n\n{answer('a-b.md', 1)}")
    assert ids(lint_docs(ws, echo(), config, changed_only=True)) == set()
    assert ws.report().first()["text"] == "# Wiki Lint Report\n\nNo major issues found."
    assert {r["file_id"] for r in ws.findings.read().collect()} == {"a/b.md", "a-b.md"}
    ws.wiki.apply(spark.createDataFrame([("c.md", "3"), ("d.md", "4")], "path string, text string"))
    assert ids(lint_docs(ws, echo(fail=["c.md"]), config, changed_only=True, limit=1)) == {
        "c.md", "d.md"}


def test_ingest_documents_roles(spark, ws):
    config = load_config({"wiki": {"role_prompt": {"suffix": "S"}, "priority_roles": ["web", "no"]}})
    done = ingest(ws, tree(spark), echo(fail=["roles/db"]), config, changed_only=True)
    assert {(r["file_id"], r["error"]) for r in done.collect()} == {
        ("web", None), ("my_app", None), ("db", "RuntimeError: roles/db")}
    docs = texts(ws.wiki)
    assert set(docs) == {"roles/web.md", "roles/my_app.md", "README.md", "index.md"}
    assert docs["roles/my_app.md"] == (
        '---\ntitle: "My App Role"\nrole: roles/my_app\ncategory: Roles\ntype: ansible-role\n'
        "tags: [ansible, role, my_app]\n---\n\nISSUE <\nRole Path: roles/my_app\n\n\n\nS>")
    assert "\n\n### tasks/main.yml\n```yaml\n- a: 1\n```\n\nS" in docs["roles/web.md"]
    assert docs["index.md"] == docs["README.md"] == (
        "# Ansible Wiki\n\n\n\n\n\n## Priority Roles\n\n- **[web](roles/web.md)** — Core role\n\n"
        "## All Roles by Category\n\n### Other Roles\n\n- [my_app](roles/my_app.md)\n"
        "- [web](roles/web.md)\n\n")
    assert set(state(ws, "ingest")) == {"web", "my_app"}
    assert ids(ingest(ws, tree(spark), echo(), config, changed_only=True)) == {"db"}
    touched = tree(spark, **{"roles/web/files/new": "n"})
    assert ids(ingest(ws, touched, echo(), config, changed_only=True)) == {"web"}
    assert ids(ingest(ws, touched, echo(), config, limit=1)) == {"db"}


def test_ingest_without_success_saves_nothing(spark, ws):
    ingest(ws, tree(spark), echo(fail=["Role Path"]), load_config(), changed_only=True)
    assert texts(ws.wiki) == {} and state(ws, "ingest") == {}


def test_ingest_ignore(spark, ws):
    config = load_config({"wiki": {"ingest_ignore": ["db", "*.yml"]}})
    assert ids(ingest(ws, tree(spark), echo(), config, changed_only=True)) == {
        "web", "my_app"}
    # ignored members are outside the fingerprint, other files are not
    quiet = tree(spark, **{"roles/web/tasks/main.yml": "- a: 2"})
    assert ids(ingest(ws, quiet, echo(), config, changed_only=True)) == set()
    loud = tree(spark, **{"roles/web/README.md": "!"})
    assert ids(ingest(ws, loud, echo(), config, changed_only=True)) == {"web"}


def test_a_role_too_large_for_a_prompt_gets_pages(spark, ws, monkeypatch):
    from corpusmill.operators import rollup
    monkeypatch.setattr(rollup.role_sections, "__defaults__", (60,))
    many = {f"roles/web/tasks/t{i}.yml": f"- item: {i}" for i in range(6)}
    ingest(ws, tree(spark, **many), echo(), load_config(), changed_only=True)
    pages = {p for p in texts(ws.wiki) if p.startswith("roles/web")}
    assert {"roles/web.md", "roles/web/page-2.md", "roles/web/page-3.md"} <= pages
    assert "- [web](roles/web.md)" in texts(ws.wiki)["index.md"]
    assert "page-2" not in texts(ws.wiki)["index.md"]
    ingest(ws, tree(spark), echo(), load_config(), changed_only=True)
    assert {p for p in texts(ws.wiki) if p.startswith("roles/web")} == {"roles/web.md"}


def test_index_from_configuration(spark, ws):
    ws.wiki.apply(spark.createDataFrame([("roles/a.md", ""), ("roles/b/c.md", ""), ("x.md", "")],
                                        "path string, text string"))
    write_index(ws, load_config({"wiki": {"title": "T", "default_category": "misc",
                                          "categories": {"k": {"roles": ["a", "c"]}}}}))
    assert "### K\n\n- [a](roles/a.md)\n\n" in texts(ws.wiki)["index.md"]
    assert "misc" not in texts(ws.wiki)["index.md"]


def test_pages_of_the_index_lead_to_the_next(spark):
    pages = spark.createDataFrame([(0, "a"), (1, "b")], "page long, text string")
    got = dict(map(tuple, index_files(pages).collect()))
    assert got["index.md"] == "a\n[Next page](index.page-2.md)\n"
    assert got["README.page-2.md"] == "b" and len(got) == 4


def test_converge_twice_does_nothing_new(spark, ws):
    config = load_config()
    first = converge(ws, tree(spark), echo(), config, DATE)
    # compiled documents, role documents and the index are all linted
    assert ids(first["lint"]) == {"README.md", "docs/a.md", "roles/web/README.md", "index.md",
                                  "roles/web.md", "roles/db.md", "roles/my_app.md"}
    assert {tuple(r) for r in summary(first).collect()} == {
        ("harvest", "processed", 4), ("ingest", "processed", 3), ("compile", "processed", 3),
        ("lint", "processed", 7), ("index", "active", 3)}
    second = converge(ws, tree(spark), echo(), config, LATER)
    assert ids(second["harvest"]) == ids(second["ingest"]) == ids(second["compile"]) == set()
    # the index was written after the first lint, over a compiled README.md
    assert ids(second["lint"]) == {"README.md"}
    third = converge(ws, tree(spark, **{"roles/db/x": "!"}), echo(), config, LATER)
    assert ids(third["ingest"]) == {"db"} and ids(third["harvest"]) == set()
    fourth = converge(ws, tree(spark).where("path != 'docs/a.md'"), echo(), config, LATER)
    assert ids(fourth["removed"]) == {"docs/a.md"}
    assert ("harvest", "removed", 1) in {tuple(r) for r in summary(fourth).collect()}


def test_config_override_is_one_level_deep():
    assert load_config({}) == load_config({"wiki": None}) == load_config()
    assert load_config({"wiki": {"llm": {"timeout": 1}}})["llm"] == {"timeout": 1}
