"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.checks import tables as t
from corpusmill.functions import paths as p
from corpusmill.functions import rules as r
from corpusmill.functions import text as x
from corpusmill.operators import (
    changes, fingerprints, lookup, media, model, pages, rollup, rules_join)
from corpusmill.plans import compile as compiling
from corpusmill.plans import index as indexing
from corpusmill.plans import ingest as ingesting
from corpusmill.plans import lint as linting
from corpusmill.plans.config import DEFAULTS, load_config
from corpusmill.plans.converge import converge
from corpusmill.plans.harvest import harvest, staged_text
from corpusmill.plans.workspace import Model, Workspace
from corpusmill.sources import files as src
from corpusmill.sources.state import parse_state
from corpusmill.sources.tables import KeyedTable
from corpusmill.sources.trees import FingerprintTree
from corpusmill.storage import materialise, scratch_path
from corpusmill.streaming.incremental import harvest_versions, read_versions

QUERIES = {}

WILDMATCH = ["archive/", "*.yaml", "/roles/src1/", "docs/**/en_*.md", "!docs/src2/en_*",
             "playbooks/wiki/src?/", "m[01].yml", "!m1.yml", "save/**"]
NAMES = ["*.yaml", "!README.md", "m?.yml", "tasks/fr_*/m0.yml", "src2/**", "*/en_*1.md"]
SUBSTRINGS = ["archive/*", "src7/", "*.yaml"]
ROLE_IGNORE = ["*.yaml", "tasks/fr_*/*"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


class _Columns:
    """``c.path`` for ``F.col("path")``; resolved when used, as columns need a session."""

    def __getattr__(self, name):
        return F.col(name)


c = _Columns()


# --- sources ---------------------------------------------------------------

@query
def scan_patterns(spark, sf):
    return src.scan_patterns(t.corpus(spark, sf)).select("path")


@query
def scan_roles(spark, sf):
    return src.scan_roles(t.corpus(spark, sf))


@query
def role_members(spark, sf):
    return rollup.role_members(t.corpus(spark, sf)).select(
        "role", "rel", "key", F.col("ord.subdir").cast("long").alias("subdir_rank"),
        F.col("ord.ext").cast("long").alias("ext_rank"))


@query
def scan_docs(spark, sf):
    every = src.scan_docs(t.corpus(spark, sf)).select("path", F.lit("all").alias("scan"))
    roles = t.active(spark, sf).select(F.concat(F.lit("roles/"), "role", F.lit(".md"))
                                       .alias("path"))
    flat = src.scan_docs(t.corpus(spark, sf).select("path").unionByName(roles), "roles",
                         recursive=False)
    return every.unionByName(flat.select("path", F.lit("roles").alias("scan")))


@query
def scan_assets(spark, sf):
    return src.scan_assets(t.media(spark, sf), "wiki")


@query
def load_state(spark, sf):
    """One small state document per labelled file; those of toxic documents are cut off."""
    saved = t.labelled(spark, sf).where("quality is not null").select(F.expr(
        """'{"harvest":{"'||path||'":"'||sha2(text, 256)||'"}'||if(toxic = 1, '', '}')""")
        .alias("json"))
    return parse_state(saved, "json")


# --- filters ---------------------------------------------------------------

@query
def ignore_wildmatch(spark, sf):
    return t.corpus(spark, sf).select("path", r.ignored_wildmatch(c.path, WILDMATCH)
                                      .alias("ignored"))


@query
def ignore_name_match(spark, sf):
    return t.corpus(spark, sf).select("path", r.ignored_by_name(c.path, NAMES).alias("ignored"))


@query
def ignore_substring(spark, sf):
    return t.corpus(spark, sf).select("path", r.ignored_by_substring(c.path, SUBSTRINGS)
                                      .alias("ignored"))


@query
def ignore_gitrules(spark, sf):
    docs = t.labelled(spark, sf).select(
        "path", "toxic", "source", F.coalesce(F.col("quality") == 1, F.lit(False))
        .alias("tracked"))
    own = docs.where("toxic = 1").select(
        F.expr("substring_index(path, '/', size(split(path, '/')) - 1)").alias("base_dir"),
        F.lit(7).cast("long").alias("seq"),
        F.concat(F.lit("/"), p.base_name(c.path)).alias("pattern"))
    per_role = docs.select("source").distinct().select(
        F.concat(F.lit("roles/"), "source").alias("base_dir"),
        F.posexplode(F.array(F.lit("# tasks"), F.lit("tasks/"), F.lit("!m2.yml")))
        .alias("seq", "pattern"))
    root = spark.range(1).select(F.lit("").alias("base_dir"), F.posexplode(
        F.array(F.lit("*.yaml"), F.lit("archive/"))).alias("seq", "pattern"))
    rules = own.unionByName(per_role).unionByName(root)
    return rules_join.ignored_by_gitrules(docs.select("path", "tracked"), rules)\
        .select("path", "ignored")


@query
def exclude_outputs(spark, sf):
    return t.corpus(spark, sf).where(~r.in_output_trees(c.path, [".wiki", "wiki"])).select("path")


@query
def exclude_names(spark, sf):
    return t.corpus(spark, sf).where(~r.is_named(c.path, "m0.yml")).select("path")


@query
def compact_lines(spark, sf):
    return t.corpus(spark, sf).select("path", x.compact_lines(c.text).alias("compacted"))


@query
def findings_filter(spark, sf):
    return t.responses(spark, sf).where(x.is_finding(F.col("response"))).select(
        "file_id", "response")


@query
def role_scope_hash_filter(spark, sf):
    roles = ingesting.role_files(t.files(spark, sf), ROLE_IGNORE)
    return roles.where(~r.is_ignored(c.path, ROLE_IGNORE)).select("role", "rel")


# --- scalar functions ------------------------------------------------------

@query
def rel_path(spark, sf):
    full = F.concat(F.lit("file:/data/tree/"), c.path)
    return t.corpus(spark, sf).select("doc_id", p.rel_path(full, "/data/tree").alias("rel"))


@query
def role_name(spark, sf):
    return t.corpus(spark, sf).select("path", p.role_name(c.path).alias("rol"))


@query
def path_stem(spark, sf):
    return t.corpus(spark, sf).select("path", p.path_stem(c.path).alias("stem"))


@query
def title_case(spark, sf):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"),
                    F.lower("p_type"), F.lit("_"), F.col("p_size").cast("string"), F.lit("fa"))
    return t.table(spark, sf, "part").select(
        F.col("p_partkey").cast("long").alias("id"), x.title_case(name).alias("title"))


@query
def add_frontmatter(spark, sf):
    return t.files(spark, sf).select("path", staged_text(c.path, c.content, t.DATE).alias("staged"))


@query
def ensure_frontmatter(spark, sf):
    body = F.when(F.col("quality") == 1, F.concat(F.lit("\n ---\n"), c.text)).otherwise(c.text)
    return t.labelled(spark, sf).select("path", x.ensure_frontmatter(
        body, p.role_name(c.path), F.concat(F.lit("roles/"), p.role_name(c.path))).alias("doc"))


@query
def truncate_text(spark, sf):
    return t.corpus(spark, sf).select("path", x.truncate_text(c.text, 6000).alias("doc"),
                                      x.truncate_text(c.text, 2500).alias("member"))


@query
def build_prompt(spark, sf):
    docs = t.corpus(spark, sf)
    no_suffix = {"prefix": "Review.", "suffix": None}
    return docs.select("path", F.explode(F.create_map(
        F.lit("compile"), x.compile_prompt(c.text, DEFAULTS["compile_prompt"]),
        F.lit("lint"), x.lint_prompt(c.path, c.text, no_suffix),
        F.lit("role"), x.role_prompt(c.path, c.text, DEFAULTS["role_prompt"]),
    )).alias("stage", "prompt"))


@query
def fence_section(spark, sf):
    return t.corpus(spark, sf).select(
        "path", x.fence_section(p.base_name(c.path), c.text).alias("section"))


@query
def relative_link(spark, sf):
    frm = F.concat(F.lit("docs/"), F.col("source"), F.lit("/sub/page.md"))
    return t.corpus(spark, sf).select("path", p.relative_link(c.path, frm).alias("link"))


@query
def render_link(spark, sf):
    stem = p.path_stem(c.path)
    return t.corpus(spark, sf).select("path", x.render_link(stem, c.path).alias("plain"),
                                      x.render_priority_link(stem, c.path).alias("priority"))


@query
def decode_text(spark, sf):
    raw = F.replace(c.text, F.lit("\n"), F.lit("\r\n")).cast("binary")
    data = F.when(F.col("toxic") == 1, F.concat(F.unhex(F.lit("FFFE")), raw)).otherwise(raw)
    return t.labelled(spark, sf).select("path", x.decode_text(data).alias("decoded"))


@query
def strip_response(spark, sf):
    padded = F.concat(F.lit(" \n "), c.text, F.lit(" 　\x1c\n"))
    return t.corpus(spark, sf).select("path", x.strip(padded).alias("stripped"))


# --- fingerprints ----------------------------------------------------------

@query
def file_fingerprint(spark, sf):
    ids = t.corpus(spark, sf).select("path").unionByName(
        t.table(spark, sf, "pages").select(F.expr("'gone/'||page_id").alias("path")))
    return ids.join(t.files(spark, sf), "path", "left").select(
        "path", fingerprints.file_fingerprint(c.content).alias("hash"))


@query
def group_fingerprint(spark, sf):
    docs = t.corpus(spark, sf).withColumn("content", c.text.cast("binary"))
    return fingerprints.group_fingerprint(docs, "source", "path", "content")


@query
def group_fingerprint_merkle(spark, sf):
    docs = t.corpus(spark, sf).select("source", "path", fingerprints.file_fingerprint(
        c.text.cast("binary")).alias("h"))
    return fingerprints.merkle_fingerprint(docs, "source", "path", "h")


@query
def fingerprint_tree(spark, sf):
    """A kept tree over all documents, then a run in which those of quality 0 changed and toxic
    ones are gone."""
    files = t.labelled(spark, sf).where("path is not null and source is not null").select(
        F.col("source").alias("grp"), F.col("path").alias("rel"),
        c.text.cast("binary").alias("text"), "quality", "toxic")
    tree = FingerprintTree(spark, scratch_path(spark, "tree"))
    tree.sync(files.withColumn("hash", fingerprints.file_fingerprint(c.text)))
    gone = F.coalesce(c.toxic == 1, F.lit(False))
    edited = files.where(~gone & (c.quality == 0)).withColumn("hash", fingerprints.file_fingerprint(
        F.concat("text", F.lit("x").cast("binary"))))
    tree.update(edited, files.where(gone))
    return tree.roots().withColumnRenamed("grp", "source")


@query
def compact_fingerprint(spark, sf):
    """Every document is one of the three functional files of a role, or another file."""
    docs = t.corpus(spark, sf).select(
        F.expr("'r'||(doc_id div 4)").alias("rol"),
        F.expr("""element_at(array('tasks/main.yml', 'defaults/main.yml', 'meta/main.yml',
            'files/x'), cast(doc_id % 4 as int) + 1)""").alias("rel"),
        c.text.cast("binary").alias("content"))
    return fingerprints.compact_fingerprint(docs, "rol", "rel", "content")


# --- joins -----------------------------------------------------------------

def _hashes(spark, sf):
    return t.files(spark, sf).select(
        c.path.alias("file_id"), fingerprints.file_fingerprint(c.content).alias("hash"))


@query
def changed_only(spark, sf):
    return changes.changed_only(_hashes(spark, sf), t.state(spark, sf), "harvest")


@query
def category_assign(spark, sf):
    return rollup.category_assign(t.listed(spark, sf), t.active(spark, sf)).select(
        "cat", F.col("role").alias("rol"))


def _assigned(spark, sf):
    act = t.active(spark, sf)
    assigned = rollup.category_assign(t.listed(spark, sf), act)
    return assigned, rollup.category_default(act, assigned)


@query
def category_default(spark, sf):
    return _assigned(spark, sf)[1].select("cat", F.col("role").alias("rol"))


@query
def priority_roles(spark, sf):
    return rollup.priority_roles(t.priority(spark, sf), t.active(spark, sf)).select(
        "pos", F.col("role").alias("rol"))


@query
def rule_antijoin(spark, sf):
    """Rules by the thousand: one per toxic document, exceptions per good one, some wildcards."""
    docs = t.labelled(spark, sf)
    own = docs.where("toxic = 1").select(F.col("doc_id").alias("seq"),
                                         F.concat(F.lit("/"), c.path).alias("pattern"))
    good = docs.where("quality = 1").select((F.col("doc_id") + 2_000_000_000).alias("seq"),
                                            F.concat(F.lit("!"), c.path).alias("pattern"))
    wide = docs.select("source").distinct().select(
        F.expr("1000000000 + cast(substr(source, 4) as long)").alias("seq"),
        F.concat(F.lit("docs/"), "source", F.lit("/d*_*.md")).alias("pattern"))
    shapes = spark.range(1).select(F.posexplode(F.array(
        F.lit("*.yaml"), F.lit("m?.yml"), F.lit("archive/**"))).alias("seq", "pattern"))
    rules = own.unionByName(good).unionByName(wide).unionByName(
        shapes.withColumn("seq", F.col("seq") + 1_500_000_000))
    return rules_join.rule_antijoin(docs.select("path"), rules)


# --- rollups ---------------------------------------------------------------

@query
def role_sections(spark, sf):
    members = ingesting.member_texts(rollup.role_members(t.files(spark, sf)))
    return rollup.role_sections(members).select(F.col("role").alias("rol"), "page", "sections")


def _assignments(spark, sf):
    both = rollup.assignment_union(*_assigned(spark, sf))
    return both, rollup.category_titles(both, t.listed(spark, sf))


@query
def category_rollup(spark, sf):
    return rollup.category_rollup(*_assignments(spark, sf)).select(
        "cat", "page", "links", "title", "description")


def _index(spark, sf):
    both, titles = _assignments(spark, sf)
    first = rollup.priority_roles(t.priority(spark, sf), t.active(spark, sf))
    return rollup.index_document(spark, both, titles, first, "Parts", "By class", "All of them")


@query
def index_document(spark, sf):
    return _index(spark, sf)


@query
def lint_report(spark, sf):
    found = t.responses(spark, sf).where(x.is_finding(F.col("response"))).select(
        "file_id", F.col("response").alias("finding"))
    return rollup.lint_report(found)


@query
def stage_counts(spark, sf):
    ran = _hashes(spark, sf).join(
        t.state(spark, sf).select("file_id", F.col("hash").alias("old_hash")), "file_id", "left")
    harvested = ran.select(F.lit("harvest").alias("stage"), F.when(
        F.col("hash").eqNullSafe(F.col("old_hash")), "skipped").otherwise("processed")
        .alias("outcome"))
    linted = t.responses(spark, sf).select(F.lit("lint").alias("stage"), F.when(
        F.col("error").isNull(), "processed").otherwise("failed").alias("outcome"))
    return changes.stage_counts(harvested.unionByName(linted))


@query
def media_section(spark, sf):
    return rollup.media_section(src.scan_assets(t.media(spark, sf), "wiki"))


# --- order, limit, sets ----------------------------------------------------

@query
def path_order(spark, sf):
    docs = t.corpus(spark, sf).select(
        F.lit("all").alias("doc"), p.components(c.path).alias("k"), c.path.alias("paths"))
    return pages.ordered_pages(docs, ["doc"], "k", "paths", "\n").select("page", "paths")


@query
def path_order_pages(spark, sf):
    """Pages of 2,000 characters of path lists, a list for each first folder."""
    docs = t.corpus(spark, sf).select(
        F.element_at(p.components(c.path), 1).alias("folder"), p.components(c.path).alias("k"),
        c.path.alias("paths"))
    return pages.ordered_pages(docs, ["folder"], "k", "paths", "\n", 2000)


def _lint_prompts(spark, sf):
    return t.corpus(spark, sf).select(
        c.path.alias("file_id"),
        x.lint_prompt(c.path, x.truncate_text(c.text, 6000), DEFAULTS["lint_prompt"]).alias("prompt"))


@query
def limit_success(spark, sf):
    prompts = _lint_prompts(spark, sf)
    tried = model.until_successes(
        prompts.select("file_id"), 50,
        lambda batch: model.call_model(lookup.fetch(prompts, batch, "file_id"), t.stub_model()))
    return tried.select("file_id", "response", "error")


@query
def pattern_union(spark, sf):
    return src.pattern_union(t.corpus(spark, sf), [
        ["docs/**/*.md"], ["*.md", "src1*/**/*.yml"], ["**/tasks/**/m1.yml"]]).select("path")


@query
def assignment_union(spark, sf):
    return rollup.assignment_union(*_assigned(spark, sf)).select(
        "cat", F.col("role").alias("rol"))


@query
def stale_split(spark, sf):
    gone, kept = changes.stale_split(t.corpus(spark, sf).select("path"),
                                     r.is_ignored(c.path, ["archive/", "en_*", "!en_*"]))
    return gone.withColumn("outcome", F.lit("removed")).unionByName(
        kept.withColumn("outcome", F.lit("kept")))


# --- state, stream, model --------------------------------------------------

def _saved(spark, sf, done):
    state = Workspace(spark, scratch_path(spark, "state")).state
    state.apply(t.state(spark, sf))
    state.apply(changes.state_of(done, "harvest"))
    return state.read()


@query
def state_upsert(spark, sf):
    done, _ = changes.split_outcomes(t.responses(spark, sf))
    return _saved(spark, sf, done)


@query
def failure_isolation(spark, sf):
    """After a run with failures: what succeeded is saved, what failed keeps its old hash."""
    done, failed = changes.split_outcomes(t.responses(spark, sf))
    saved = _saved(spark, sf, done).select("file_id", "hash")
    tried = done.select("file_id", F.lit("ok").alias("outcome")).unionByName(
        failed.select("file_id", F.concat(F.lit("failed: "), "error").alias("outcome")))
    return tried.join(saved, "file_id", "left")


@query
def incremental_stream(spark, sf):
    """All versions of each path arrive; the last one is staged."""
    folder = scratch_path(spark, "versions")
    t.corpus(spark, sf).select(
        F.expr("'docs/'||source||'/'||lang||'.md'").alias("path"),
        F.col("doc_id").alias("version"), c.text.cast("binary").alias("content"),
    ).write.parquet(folder)
    ws = Workspace(spark, scratch_path(spark, "stream"))
    harvest_versions(read_versions(spark, folder), ws, load_config(), t.DATE,
                     scratch_path(spark, "stream-progress")).awaitTermination()
    return ws.raw.read()


@query
def model_batch(spark, sf):
    return model.call_model(_lint_prompts(spark, sf), t.stub_model())


@query
def retry_calls(spark, sf):
    return model.call_model(_lint_prompts(spark, sf), t.flaky_model(), attempts=5, delay=0)


# --- sinks -----------------------------------------------------------------

@query
def upsert_docs(spark, sf):
    docs = t.labelled(spark, sf)
    table = KeyedTable(spark, scratch_path(spark, "docs"), ["path"], "path string, text string")
    table.apply(docs.where("quality is not null").select(
        "path", F.concat(F.lit("old "), "path").alias("text")))
    table.apply(docs.where("quality = 0").select("path", "text"),
                deletes=docs.where("toxic = 1 and quality = 1").select("path"))
    table.apply(docs.where("quality is null").select("path", "text"))
    return table.read()


@query
def write_report(spark, sf):
    ws = Workspace(spark, scratch_path(spark, "report"))
    found = t.responses(spark, sf).select("file_id", F.col("response").alias("finding"))
    ws.save_report(rollup.lint_report(found.where("finding like 'Issue%'")))
    ws.save_report(rollup.lint_report(found.where("finding like 'Sugg%'")))
    return ws.report()


@query
def write_index(spark, sf):
    return indexing.index_files(_index(spark, sf))


@query
def append_section(spark, sf):
    docs = materialise(indexing.index_files(_index(spark, sf)), "index")
    section = materialise(
        rollup.media_section(src.scan_assets(t.media(spark, sf), "wiki")), "media")
    once = media.append_section(docs, section)
    return media.append_section(once, section)


# --- whole runs ------------------------------------------------------------

def _workspace(spark, name):
    return Workspace(spark, scratch_path(spark, name))


@query
def harvest_run(spark, sf):
    """Incremental: staged documents exist, some outdated, ignored now, or without source."""
    ws = _workspace(spark, "harvest")
    known = t.labelled(spark, sf).where("quality is not null and path like '%.md'").select("path")
    gone = t.table(spark, sf, "pages").select(F.expr("'docs/gone/'||page_id||'.md'")
                                              .alias("path"))
    ws.raw.apply(known.unionByName(gone).select(
        "path", F.concat(F.lit("old "), "path").alias("text"), F.lit("").alias("source_hash")))
    ws.state.apply(t.state(spark, sf))
    harvest(ws, t.files(spark, sf), load_config(), t.DATE, changed_only=True)
    return ws.raw.read().select("path", "text")


@query
def ingest_run(spark, sf):
    """Saved role hashes leave out toxic documents, so roles that have one are changed."""
    ws = _workspace(spark, "ingest")
    clean = t.labelled(spark, sf).where("coalesce(toxic, 0) = 0").select(
        "path", c.text.cast("binary").alias("content"))
    ws.state.apply(ingesting.role_hashes(ingesting.role_files(clean, []), []).select(
        F.lit("ingest").alias("stage"), "file_id", "hash"))
    ingesting.ingest(ws, t.files(spark, sf), Model(t.stub_model()), load_config(),
                     changed_only=True)
    return ws.wiki.read()


@query
def compile_run(spark, sf):
    ws = _workspace(spark, "compile")
    ws.raw.apply(src.scan_docs(t.corpus(spark, sf)).select(
        "path", "text", F.sha2(c.text.cast("binary"), 256).alias("source_hash")))
    ws.state.apply(t.state(spark, sf, "compile"))
    compiling.compile_docs(ws, Model(t.stub_model()), load_config(), changed_only=True)
    return ws.wiki.read()


@query
def lint_run(spark, sf):
    ws = _workspace(spark, "lint")
    ws.wiki.apply(src.scan_docs(t.corpus(spark, sf)).select("path", "text"))
    ws.state.apply(t.state(spark, sf, "lint"))
    linting.lint_docs(ws, Model(t.stub_model()), load_config(), changed_only=True)
    return ws.report()


@query
def index_run(spark, sf):
    ws = _workspace(spark, "index")
    ws.wiki.apply(t.active(spark, sf).select(
        F.concat(F.lit("roles/"), "role", F.lit(".md")).alias("path"),
        F.concat(F.lit("doc of "), "role").alias("text")))
    config = load_config({"wiki": {"title": "Parts", "subtitle": "By class",
                                   "description": "All of them"}})
    indexing.write_index(ws, config, t.listed(spark, sf), t.priority(spark, sf))
    return ws.wiki.read()


@query
def converge_run(spark, sf):
    """All stages from nothing; what is published, and the report."""
    ws = _workspace(spark, "converge")
    converge(ws, t.files(spark, sf), Model(t.stub_model()), load_config(), t.DATE)
    return ws.wiki.read().unionByName(ws.report().select(
        F.concat(F.lit("report "), F.col("page").cast("string")).alias("path"), "text"))
