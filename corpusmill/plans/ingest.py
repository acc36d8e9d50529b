"""Have the model document each role from its YAML members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.paths import rel_path
from corpusmill.functions.rules import is_ignored
from corpusmill.functions.text import (
    compact_lines, decode_text, ensure_frontmatter, role_prompt, truncate_text)
from corpusmill.operators.changes import split_outcomes, state_of
from corpusmill.operators.lookup import fetch
from corpusmill.operators.fingerprints import file_fingerprint, group_fingerprint
from corpusmill.operators.model import until_successes
from corpusmill.operators.rollup import ROLES_DIR, role_members, role_sections
from corpusmill.plans.config import MAX_MEMBER_CHARS
from corpusmill.plans.index import write_index
from corpusmill.plans.workspace import Model, Workspace, answer_in_chunks, new_run, select_work
from corpusmill.sources.trees import FingerprintTree
from corpusmill.storage import materialise, observed

STAGE = "ingest"


def role_files(files: DataFrame, ignore: list[str], mode: str = "compat") -> DataFrame:
    """Files of the roles that no rule drops: (role, role_path, path, rel, content)."""
    found = F.regexp_extract("path", f"^({ROLES_DIR}/([^/]+))/", 1)
    roles = files.withColumn("role_path", found).where(F.col("role_path") != "")
    return (roles.where(~is_ignored(F.col("role_path"), ignore, mode))
            .withColumn("role", rel_path(F.col("role_path"), ROLES_DIR))
            .withColumn("rel", F.substring("path", F.length("role_path") + 2,
                                           F.length("path"))))


def role_hashes(roles: DataFrame, ignore: list[str], mode: str = "compat",
                tree: FingerprintTree | None = None) -> DataFrame:
    """(file_id, hash) per role over its files that no rule drops. A role whose files are
    all dropped still has a hash, that of nothing. With a ``tree`` what did not change since the
    last run is not hashed again."""
    empty = F.sha2(F.lit("").cast("binary"), 256)
    kept = roles.where(~is_ignored(F.col("path"), ignore, mode))
    if tree:
        tree.sync(kept.select(F.col("role").alias("grp"), "rel",
                              file_fingerprint(F.col("content")).alias("hash")))
        prints = tree.roots().withColumnRenamed("grp", "role")
    else:
        prints = group_fingerprint(kept, "role", "rel", "content")
    if not ignore:
        return prints.select(F.col("role").alias("file_id"), F.col("fingerprint").alias("hash"))
    return (roles.select("role").distinct().join(prints, "role", "left")
            .select(F.col("role").alias("file_id"), F.coalesce("fingerprint", empty)
                    .alias("hash")))


def member_texts(members: DataFrame) -> DataFrame:
    """Compacted, bounded member texts; members that are not UTF-8 are left out."""
    readable = F.try_validate_utf8(F.col("content").cast("string")).isNotNull()
    text = compact_lines(decode_text(F.col("content")))
    return members.where(readable).select(
        "role", "key", "ord", truncate_text(text, MAX_MEMBER_CHARS).alias("content"))


def role_prompts(roles: DataFrame, members: DataFrame, prompt: dict | None) -> DataFrame:
    """(role, page, prompt); a role without members still gets one prompt."""
    pages = role_sections(members)
    role_path = F.concat(F.lit(ROLES_DIR + "/"), F.col("role"))
    return (roles.select("role").join(pages, "role", "left")
            .select("role", F.coalesce("page", F.lit(0).cast("long")).alias("page"),
                    role_prompt(role_path, F.coalesce("sections", F.lit("")), prompt)
                    .alias("prompt")))


def role_documents(answers: DataFrame) -> DataFrame:
    """(path, text) from (role, page, response): the first page is the role's document,
    further pages of a very large role go below it."""
    role, page = F.col("role"), F.col("page")
    role_path = F.concat(F.lit(ROLES_DIR + "/"), role)
    first = ensure_frontmatter(F.col("response"), role, role_path)
    return answers.select(
        F.when(page == 0, F.concat(role_path, F.lit(".md"))).otherwise(
            F.concat(role_path, F.lit("/page-"), (page + 1).cast("string"), F.lit(".md")))
        .alias("path"),
        F.when(page == 0, first).otherwise(F.col("response")).alias("text"))


def stale_pages(ws: Workspace, done: DataFrame, docs: DataFrame) -> DataFrame:
    """Paths of further pages that a role had and no longer has."""
    pages = ws.wiki.read().select("path").where(
        F.col("path").rlike(f"^{ROLES_DIR}/[^/]+/page-[0-9]+\\.md\\z"))
    role = F.regexp_extract("path", f"^{ROLES_DIR}/([^/]+)/", 1)
    return (pages.withColumn("role", role).join(done, "role", "left_semi")
            .join(docs, "path", "left_anti").select("path"))


def ingest(ws: Workspace, files: DataFrame, model: Model, config: dict,
           changed_only: bool = False, limit: int | None = None, mode: str = "compat") -> DataFrame:
    """Document the roles in ``files`` (path, content). Returns (file_id, error, hash) of
    the tried roles. The index follows if at least one role succeeded.

    A role counts as done when all its pages are. Roles are asked for and saved in chunks.
    """
    ignore = config["ingest_ignore"]
    roles = role_files(files, ignore, mode)
    work = select_work(role_hashes(roles, ignore, mode, ws.tree), ws, STAGE, changed_only)
    run_name = new_run()

    def ask(batch: DataFrame) -> DataFrame:
        names = batch.select(F.col("file_id").alias("role"))
        members = role_members(roles)
        if changed_only or limit:
            members = fetch(members, names, "role")
        prompts = materialise(
            role_prompts(names, member_texts(members), config["role_prompt"]), "role-prompts")
        replies = materialise(model.answer(prompts, config["llm"]), "role-replies")
        answers.append(replies)
        return (replies.groupBy(F.col("role").alias("file_id"))
                .agg(F.max("error").alias("error"),
                     F.sum("attempts").cast("long").alias("attempts"))
                .join(batch, "file_id"))

    def save(outcomes: DataFrame, run: str, chunk: int) -> None:
        done, failed = split_outcomes(outcomes)
        ok = materialise(done.select(F.col("file_id").alias("role")), "roles-done")
        replies = reduce(DataFrame.unionByName, answers)  # one per round of the limit loop
        docs = materialise(role_documents(fetch(replies, ok, "role")), "role-docs")
        ws.wiki.apply(docs, deletes=stale_pages(ws, fetch(replies.select("role"), ok, "role"), docs),
                      run=run, batch=chunk)
        ws.state.apply(state_of(done, STAGE), run=run, batch=chunk)
        ws.quarantine(failed, STAGE, run, chunk)
        answers.clear()

    answers: list[DataFrame] = []
    if limit:
        outcomes = until_successes(work, limit, ask)
        save(outcomes, run_name, 0)
    else:
        outcomes = answer_in_chunks(ws, work, observed(work)["processed"], model, ask,
                                    run_name, save)
    if observed(outcomes)["processed"]:
        write_index(ws, config)
    return outcomes
