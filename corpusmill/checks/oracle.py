"""The same results in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from corpusmill.checks.tables import DATE
from corpusmill.functions.text import TRUNCATION_MARKER
from corpusmill.operators.pages import PAGE_CHARS
from corpusmill.operators.rollup import (
    CATEGORY_HEADING, DEFAULT_CATEGORY, DEFAULT_CATEGORY_TITLE, INDEX_TITLE, MEDIA_HEADING,
    PRIORITY_HEADING, REPORT_EMPTY, REPORT_HEADING)
from corpusmill.plans.config import DEFAULTS

ORACLE: dict[str, str] = {}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SP = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
      r"\x{205f}\x{3000}]")
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def strip(s: str) -> str:
    return f"regexp_replace({s}, '^{SP}+|{SP}+$', '', 'g')"


def lines(s: str) -> str:
    return (f"list_filter(regexp_split_to_array({s}, '{BREAK}'), "
            f"lambda l: NOT regexp_matches(l, '^{SP}*(#|$)'))")


def compact(s: str) -> str:
    return f"array_to_string({lines(s)}, chr(10))"


def truncated(s: str, m: int) -> str:
    return (f"CASE WHEN length({s}) > {2 * m} THEN substr({s}, 1, {m})||{lit(TRUNCATION_MARKER)} "
            f"ELSE {s} END")


def pages(rows: str, keys: str, order: str, text: str, sep: str, chars: int = PAGE_CHARS) -> str:
    """Pages of ``rows``; ``keys`` is empty or ends with a comma."""
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    n = len(sep)
    return f"""SELECT {keys} page, string_agg({text}, {lit(sep)} ORDER BY {order}) AS {text}
        FROM (SELECT *, CAST((sum(length({text}) + {n}) OVER ({part} ORDER BY {order}
                ROWS UNBOUNDED PRECEDING) - length({text}) - {n}) // {chars} AS BIGINT) AS page
              FROM ({rows})) GROUP BY {keys} page"""


CORPUS = r"""corpus AS (SELECT CASE (doc_id // 20) % 5
    WHEN 0 THEN 'docs/'||source||'/'||lang||'_'||doc_id||'.md'
    WHEN 1 THEN 'roles/'||source||'/tasks/'||lang||'_'||doc_id||'/m'
                ||((doc_id // 100) % 3)||'.yml'
    WHEN 2 THEN 'roles/'||source||'/defaults/'||lang||'_'||doc_id||'.yaml'
    WHEN 3 THEN 'archive/'||source||'/'||lang||'_'||doc_id||'.md'
    ELSE 'playbooks/wiki/'||source||'/'||lang||'_'||doc_id||'.md' END AS path,
    '# '||lang||chr(10)||'  '||chr(10)||text AS text, doc_id, lang, source FROM documents),
docs AS (SELECT corpus.*, string_split(path, '/') AS k,
    list_extract(string_split(path, '/'), -1) AS name, quality, toxic
    FROM corpus LEFT JOIN labels USING (doc_id)),
state AS (SELECT path AS file_id, sha256(CASE WHEN quality = 0 THEN text||'x' ELSE text END) AS hash
    FROM docs WHERE quality IS NOT NULL),
responses AS (SELECT path AS file_id, k, CASE WHEN toxic = 1 THEN NULL
    WHEN quality = 0 THEN 'Issue: '||path WHEN quality = 1 THEN 'ok '||path
    ELSE 'Suggestions: '||path END AS response,
    CASE WHEN toxic = 1 THEN 'refused' END AS error, sha256(text) AS hash FROM docs)
"""
PARTS = """listed AS (SELECT lower(p_type)||'_parts' AS cat,
    CASE WHEN p_type = 'PROMO' THEN 'Promotions' END AS title,
    CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'Size class '||lower(p_type) END AS description,
    p_name||' '||p_brand AS rol FROM part),
active AS (SELECT p_name||' '||p_brand AS rol FROM part WHERE p_size <= 25
    UNION SELECT s_name FROM supplier WHERE s_acctbal > 0),
assigned AS (SELECT cat, rol FROM listed WHERE rol IN (SELECT rol FROM active)),
defaulted AS (SELECT 'other' AS cat, rol FROM active
    WHERE rol NOT IN (SELECT rol FROM assigned)),
everything AS (SELECT * FROM assigned UNION ALL SELECT * FROM defaulted),
titles AS (SELECT cat, CASE cat WHEN 'other' THEN 'Other Roles'
        WHEN 'promo_parts' THEN 'Promotions'
        ELSE upper(cat[1])||replace(cat[2:], '_parts', ' Parts') END AS title,
    CASE WHEN cat IN ('small_parts', 'large_parts')
        THEN 'Size class '||replace(cat, '_parts', '') ELSE '' END AS description
    FROM (SELECT DISTINCT cat FROM everything)),
first_roles AS (SELECT CAST(s_suppkey AS BIGINT) AS pos, s_name AS rol FROM supplier
    WHERE s_name IN (SELECT rol FROM active))
"""
MEDIA = """assets AS (SELECT 'wiki/media/'||split_part(url, '/', 3)||'/p.'||page_id||'.png' AS path,
    'p.'||page_id AS stem, 'media/'||split_part(url, '/', 3)||'/p.'||page_id||'.png' AS link
    FROM pages WHERE contains(url, '?'))
"""


def link(role: str) -> str:
    return f"'- ['||{role}||'](roles/'||{role}||'.md)'"


def index_lines(title: str, subtitle: str, description: str, priority: bool) -> str:
    head = f"# {title}\n\n{subtitle}\n\n{description}\n\n"
    first = f"""UNION ALL SELECT 1, '', -1, '', {lit(PRIORITY_HEADING)}||repeat(chr(10), 2)
        UNION ALL SELECT 1, '', pos, rol,
            '- **['||rol||'](roles/'||rol||'.md)** — Core role'||chr(10) FROM first_roles
        UNION ALL SELECT 2, '', 0, '', chr(10)""" if priority else ""
    return f"""SELECT 0 AS s, '' AS cat, 0 AS r, '' AS n, {lit(head)} AS text {first}
        UNION ALL SELECT 3, '', 0, '', {lit(CATEGORY_HEADING)}||repeat(chr(10), 2)
        UNION ALL SELECT 4, cat, 0, '', '### '||title||chr(10)||CASE WHEN description = '' THEN ''
            ELSE '*'||description||'*'||chr(10) END||chr(10) FROM titles
        UNION ALL SELECT 4, cat, 1, rol, {link('rol')}||chr(10) FROM everything
        UNION ALL SELECT 4, cat, 2, '', chr(10) FROM titles"""


def index_sql(*args) -> str:
    return pages(index_lines(*args), "", "s, cat, r, n", "text", "")


def index_files(index: str) -> str:
    return f"""SELECT CASE WHEN page = 0 THEN n||'.md' ELSE n||'.page-'||(page + 1)||'.md' END AS path,
        text||CASE WHEN page < max(page) OVER () THEN
            chr(10)||'[Next page]('||n||'.page-'||(page + 2)||'.md)'||chr(10) ELSE '' END AS text
        FROM ({index}), (VALUES ('README'), ('index')) AS names(n)"""


def answer(n: str) -> str:
    return f"""CASE WHEN {n} % 11 = 0 THEN NULL
        WHEN {n} % 7 = 0 THEN '---'||chr(10)||'kept: '||{n}||chr(10)||'---'
        WHEN {n} % 3 = 0 THEN 'Issue: '||{n} WHEN {n} % 3 = 1 THEN 'ok '||{n}
        ELSE 'Suggestions: '||{n} END"""


def refusal(n: str) -> str:
    return f"CASE WHEN {n} % 11 = 0 THEN 'ValueError: refused '||{n} END"


def prompt(kind: str, middle: str) -> str:
    parts = DEFAULTS[kind]
    return f"{lit(parts['prefix'])}||{middle}||chr(10)||chr(10)||{lit(parts['suffix'])}"


def compile_prompt(s: str) -> str:
    return prompt("compile_prompt", lit("\n\nOriginal content:\n") + f"||{s}")


def lint_prompt(path: str, s: str) -> str:
    return prompt("lint_prompt", lit("\n\nFile: ") + f"||{path}||" + lit("\n\nContent:\n")
                  + f"||{s}")


def role_prompt(path: str, s: str) -> str:
    return prompt("role_prompt", lit("\nRole Path: ") + f"||{path}||" + lit("\n\n") + f"||{s}")


def staged(path: str, s: str) -> str:
    return strip(lit(f"---\nharvested_date: '{DATE}'\noriginal_path: ") + f"||{path}||"
                 + lit("\nsource_type: legacy_markdown\n---\n\n") + f"||{s}")


def role_doc(role: str, s: str) -> str:
    title = f"upper(({role})[1])||({role})[2:]"
    return (f"CASE WHEN regexp_matches({s}, '^{SP}*---') THEN {s} ELSE " + lit('---\ntitle: "')
            + f"||{title}||" + lit(' Role"\nrole: roles/') + f"||{role}||"
            + lit("\ncategory: Roles\ntype: ansible-role\ntags: [ansible, role, ")
            + f"||{role}||" + lit("]\n---\n\n") + f"||{s} END")


def report(findings: str) -> str:
    """Report pages over (k, text)."""
    return pages(f"""SELECT 1 AS r, k, text FROM ({findings})
        UNION ALL SELECT 0, NULL, {lit(REPORT_HEADING)}
        UNION ALL SELECT 2, NULL, {lit(REPORT_EMPTY)}
            WHERE NOT EXISTS (SELECT 1 FROM ({findings}))""", "", "r, k", "text", "\n\n")


MEMBERS = f"""members AS (SELECT source AS rol, path[length('roles/'||source) + 2:] AS rel,
        path LIKE '%.yaml' AS yaml, path LIKE '%/tasks/%' AS tasks,
        {truncated(compact('text'), 2500)} AS content FROM docs WHERE path LIKE 'roles/%'),
    ranked AS (SELECT *, CASE WHEN tasks THEN 'tasks/' ELSE 'defaults/' END
            ||list_extract(string_split(rel, '/'), -1) AS key,
        row_number() OVER (PARTITION BY rol ORDER BY tasks, yaml, string_split(rel, '/')) AS rn
        FROM members),
    merged AS (SELECT rol, min(rn) AS pos, '### '||key||{lit(chr(10) + '```yaml' + chr(10))}
        ||arg_max(content, rn)||{lit(chr(10) + '```')} AS sections FROM ranked GROUP BY rol, key),
    sectioned AS ({pages('SELECT * FROM merged', 'rol, ', 'pos', 'sections', chr(10) * 2)})
"""


def sql(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + body


def on_corpus(name: str, body: str, *ctes: str) -> None:
    sql(name, body, CORPUS, *ctes)


# --- sources ---------------------------------------------------------------

on_corpus("scan_patterns", "SELECT path FROM docs WHERE path LIKE '%.md'")
on_corpus("scan_roles", "SELECT DISTINCT source AS role FROM docs WHERE path LIKE 'roles/%'")
on_corpus("role_members", """SELECT source AS role, path[length('roles/'||source) + 2:] AS rel,
    split_part(path, '/', 3)||'/'||name AS key,
    CASE split_part(path, '/', 3) WHEN 'defaults' THEN 1::BIGINT ELSE 2::BIGINT END AS subdir_rank,
    CASE WHEN path LIKE '%.yml' THEN 0::BIGINT ELSE 1::BIGINT END AS ext_rank
    FROM docs WHERE path LIKE 'roles/%'""")
on_corpus("scan_docs", """SELECT path, 'all' AS scan FROM docs WHERE path LIKE '%.md'
    UNION ALL SELECT 'roles/'||rol||'.md', 'roles' FROM active""", PARTS)
sql("scan_assets", "SELECT path, stem, link FROM assets", MEDIA)
on_corpus("load_state", """SELECT 'harvest' AS stage, path AS file_id, sha256(text) AS hash
    FROM docs WHERE quality IS NOT NULL AND toxic = 0""")

# --- filters ---------------------------------------------------------------

on_corpus("ignore_wildmatch", r"""SELECT path, CASE
    WHEN regexp_matches(path, '^save/.+') THEN true
    WHEN regexp_matches(path, '(^|/)m1\.yml(/|$)') THEN false
    WHEN regexp_matches(path, '(^|/)m[01]\.yml(/|$)') THEN true
    WHEN regexp_matches(path, '^playbooks/wiki/src[^/]/.+') THEN true
    WHEN regexp_matches(path, '^docs/src2/en_[^/]*(/|$)') THEN false
    WHEN regexp_matches(path, '^docs/(.+/)?en_[^/]*\.md(/|$)') THEN true
    WHEN regexp_matches(path, '^roles/src1/.+') THEN true
    WHEN regexp_matches(path, '(^|/)[^/]*\.yaml(/|$)') THEN true
    WHEN regexp_matches(path, '(^|/)archive/.+') THEN true
    ELSE false END AS ignored FROM docs""")
on_corpus("ignore_name_match", r"""SELECT path, name LIKE '%.yaml' OR regexp_matches(name, '^m.\.yml$')
    OR regexp_matches(path, '(^|/)tasks/fr_[^/]*/m0\.yml$')
    OR regexp_matches(path, '(^|/)src2/[^/]+$')
    OR regexp_matches(path, '(^|/)[^/]+/en_[^/]*1\.md$') AS ignored FROM docs""")
on_corpus("ignore_substring", """SELECT path, starts_with(path, 'archive/') OR contains(path, 'src7/')
    OR path LIKE '%.yaml' AS ignored FROM docs""")
on_corpus("ignore_gitrules", """SELECT path, CASE WHEN quality = 1 THEN false WHEN toxic = 1 THEN true
    WHEN path LIKE 'roles/%/tasks/%' THEN name <> 'm2.yml'
    ELSE path LIKE '%.yaml' OR starts_with(path, 'archive/') END AS ignored FROM docs""")
on_corpus("exclude_outputs", """SELECT path FROM docs WHERE NOT list_contains(k, 'wiki')
    AND NOT list_contains(k, '.wiki')""")
on_corpus("exclude_names", "SELECT path FROM docs WHERE name <> 'm0.yml'")
on_corpus("compact_lines", f"SELECT path, {compact('text')} AS compacted FROM docs")
on_corpus("findings_filter", """SELECT file_id, response FROM responses
    WHERE regexp_matches(lower(response), 'issue|missing|suggest')""")
on_corpus("role_scope_hash_filter", r"""SELECT source AS role, path[length('roles/'||source) + 2:] AS rel
    FROM docs WHERE path LIKE 'roles/%' AND path NOT LIKE '%.yaml'
    AND NOT regexp_matches(path, '/tasks/fr_[^/]*/[^/]+$')""")

# --- scalar functions ------------------------------------------------------

on_corpus("rel_path", "SELECT doc_id, path AS rel FROM docs")
on_corpus("role_name", "SELECT path, source AS rol FROM docs")
on_corpus("path_stem", r"SELECT path, regexp_replace(name, '\.[^.]+$', '') AS stem FROM docs")
sql("title_case", """SELECT CAST(p_partkey AS BIGINT) AS id, array_to_string(list_transform(
    regexp_extract_all(p_name||'-'||lower(p_type)||' '||p_size||'fa', '[a-z]+|[^a-z]+'),
    lambda w: upper(w[1])||w[2:]), '') AS title FROM part""")
on_corpus("add_frontmatter", f"SELECT path, {staged('path', 'text')} AS staged FROM docs")
on_corpus("ensure_frontmatter", f"""SELECT path, {role_doc('source', 'body')} AS doc FROM (
    SELECT *, CASE WHEN quality = 1 THEN chr(10)||' ---'||chr(10)||text ELSE text END AS body
    FROM docs)""")
on_corpus("truncate_text", f"""SELECT path, {truncated('text', 6000)} AS doc,
    {truncated('text', 2500)} AS member FROM docs""")
on_corpus("build_prompt", f"""SELECT path, 'compile' AS stage, {compile_prompt('text')} AS prompt
        FROM docs
    UNION ALL SELECT path, 'lint', 'Review.'||{lit(chr(10) * 2 + 'File: ')}||path
        ||{lit(chr(10) * 2 + 'Content:' + chr(10))}||text||{lit(chr(10) * 2)} FROM docs
    UNION ALL SELECT path, 'role', {role_prompt('path', 'text')} FROM docs""")
on_corpus("fence_section", f"""SELECT path, '### '||name||{lit(chr(10) + '```yaml' + chr(10))}
    ||text||{lit(chr(10) + '```')} AS section FROM docs""")
on_corpus("relative_link", """SELECT path, repeat('../', 3 - n)||array_to_string(k[n + 1:], '/') AS link
    FROM (SELECT path, k, CASE WHEN k[1] <> 'docs' THEN 0 WHEN k[2] <> source THEN 1
        WHEN k[3] <> 'sub' THEN 2 ELSE 3 END AS n FROM docs)""")
on_corpus("render_link", r"""SELECT path, '- ['||stem||']('||path||')' AS plain,
    '- **['||stem||']('||path||')** — Core role' AS priority
    FROM (SELECT path, regexp_replace(name, '\.[^.]+$', '') AS stem FROM docs)""")
on_corpus("decode_text", """SELECT path, CASE WHEN toxic = 1 THEN NULL ELSE text END AS decoded
    FROM docs""")
on_corpus("strip_response", f"SELECT path, {strip('text')} AS stripped FROM docs")

# --- fingerprints ----------------------------------------------------------

on_corpus("file_fingerprint", """SELECT path, sha256(text) AS hash FROM docs
    UNION ALL SELECT 'gone/'||page_id, '' FROM pages""")


def group_tree(rows: str) -> str:
    return f"""SELECT source, sha256(string_agg(node||':'||h, chr(10)
        ORDER BY node||':'||h)) AS fingerprint FROM (
    SELECT source, node[:2] AS node, sha256(string_agg(node||':'||h, chr(10)
        ORDER BY node||':'||h)) AS h FROM (
    SELECT source, sha256(path)[:4] AS node, sha256(string_agg(path||':'||sha256(text), chr(10)
        ORDER BY path||':'||sha256(text))) AS h FROM {rows} GROUP BY 1, 2) GROUP BY 1, 2)
    GROUP BY 1"""


GROUP_TREE = group_tree("docs")
on_corpus("group_fingerprint", GROUP_TREE)
on_corpus("group_fingerprint_merkle", GROUP_TREE)
on_corpus("fingerprint_tree", group_tree("""(SELECT source, path,
    CASE WHEN quality = 0 THEN text||'x' ELSE text END AS text
    FROM docs WHERE coalesce(toxic, 0) <> 1 AND path IS NOT NULL AND source IS NOT NULL)"""))
SQUEEZED = (f"array_to_string(list_transform({lines('text')}, lambda l: {strip('l')}), '')")
on_corpus("compact_fingerprint", f"""SELECT 'r'||(doc_id // 4) AS rol, md5(
    coalesce(max(s) FILTER (doc_id % 4 = 0), '')||coalesce(max(s) FILTER (doc_id % 4 = 1), '')
    ||coalesce(max(s) FILTER (doc_id % 4 = 2), '')) AS fingerprint
    FROM (SELECT doc_id, {SQUEEZED} AS s FROM docs) GROUP BY 1""")

# --- joins -----------------------------------------------------------------

CHANGED = """changed AS (SELECT path AS file_id, sha256(text) AS hash, state.hash AS old_hash
    FROM docs LEFT JOIN state ON path = file_id WHERE sha256(text) IS DISTINCT FROM state.hash)"""
on_corpus("changed_only", "SELECT * FROM changed", CHANGED)
sql("category_assign", "SELECT * FROM assigned", PARTS)
sql("category_default", "SELECT * FROM defaulted", PARTS)
sql("priority_roles", "SELECT pos, rol FROM first_roles", PARTS)
on_corpus("rule_antijoin", r"""SELECT path FROM docs WHERE coalesce(quality = 1, false)
    OR NOT (path LIKE '%.yaml' OR regexp_matches(path, '(^|/)m[^/]\.yml$')
        OR starts_with(path, 'archive/') OR regexp_matches(path, '^docs/[^/]+/d[^/]*_[^/]*\.md$')
        OR coalesce(toxic = 1, false))""")

# --- rollups ---------------------------------------------------------------

on_corpus("role_sections", "SELECT rol, page, sections FROM sectioned", MEMBERS)
ROLLUP = pages(f"SELECT cat, rol, {link('rol')} AS links FROM everything", "cat, ", "rol",
               "links", "\n")
sql("category_rollup", f"""SELECT cat, page, links, title, description
    FROM ({ROLLUP}) JOIN titles USING (cat)""", PARTS)
INDEX = index_sql("Parts", "By class", "All of them", True)
sql("index_document", INDEX, PARTS)
on_corpus("lint_report", report("""SELECT k, response AS text FROM responses
    WHERE regexp_matches(lower(response), 'issue|missing|suggest')"""))
on_corpus("stage_counts", """SELECT stage, outcome, count(*) AS n FROM (
    SELECT 'harvest' AS stage, CASE WHEN file_id IN (SELECT file_id FROM changed)
        THEN 'processed' ELSE 'skipped' END AS outcome FROM responses
    UNION ALL SELECT 'lint', CASE WHEN error IS NULL THEN 'processed' ELSE 'failed' END
        FROM responses) GROUP BY 1, 2""", CHANGED)
SECTION = pages(f"""SELECT ['']::VARCHAR[] AS k, {lit(MEDIA_HEADING)} AS text
    UNION ALL SELECT string_split(link, '/'), '- ['||stem||']('||link||')' FROM assets""",
                "", "k", "text", "\n")
sql("media_section", SECTION, MEDIA)

# --- order, limit, sets ----------------------------------------------------

on_corpus("path_order", pages("SELECT k, path AS paths FROM docs", "", "k", "paths", "\n"))
on_corpus("path_order_pages", pages("SELECT k[1] AS folder, k, path AS paths FROM docs", "folder, ",
                                    "k", "paths", "\n", 2000))
N = (f"(SELECT *, length({lint_prompt('path', truncated('text', 6000))}) AS n FROM docs)")
on_corpus("limit_success", f"""SELECT path AS file_id, {answer('n')} AS response,
    {refusal('n')} AS error FROM (SELECT path, n, coalesce(sum(CASE WHEN n % 11 = 0 THEN 0 ELSE 1 END)
        OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {N})
    WHERE before < 50""")
on_corpus("pattern_union", r"""SELECT path FROM docs WHERE path LIKE '%.md'
    OR regexp_matches(path, '(^|/)src1[^/]*/(.+/)?[^/]*\.yml$')
    OR regexp_matches(path, '(^|/)tasks/(.+/)?m1\.yml$')""")
sql("assignment_union", "SELECT * FROM everything", PARTS)
on_corpus("stale_split", """SELECT path, CASE WHEN starts_with(path, 'archive/')
    OR starts_with(name, 'en_') THEN 'removed' ELSE 'kept' END AS outcome FROM docs""")

# --- state, stream, model --------------------------------------------------

SAVED = """saved AS (SELECT coalesce(r.file_id, s.file_id) AS file_id, coalesce(r.hash, s.hash) AS hash
    FROM (SELECT * FROM responses WHERE error IS NULL) r FULL JOIN state s ON r.file_id = s.file_id)"""
on_corpus("state_upsert", "SELECT 'harvest' AS stage, file_id, hash FROM saved", SAVED)
on_corpus("failure_isolation", """SELECT r.file_id, coalesce('failed: '||error, 'ok') AS outcome,
    saved.hash FROM responses r LEFT JOIN saved ON r.file_id = saved.file_id""", SAVED)
on_corpus("incremental_stream", f"""SELECT path, {staged('path', 'text')} AS text,
    sha256(text) AS source_hash FROM (SELECT 'docs/'||source||'/'||lang||'.md' AS path,
    arg_max(text, doc_id) AS text FROM corpus GROUP BY 1)""")
on_corpus("model_batch", f"""SELECT path AS file_id, {answer('n')} AS response,
    {refusal('n')} AS error, 1::BIGINT AS attempts FROM {N}""")
on_corpus("retry_calls", f"""SELECT path AS file_id, CASE WHEN n % 7 < 5 THEN 'done '||n END AS response,
    CASE WHEN n % 7 >= 5 THEN 'TimeoutError: busy '||n END AS error,
    least(n % 7 + 1, 5)::BIGINT AS attempts FROM {N}""")

# --- sinks -----------------------------------------------------------------

on_corpus("upsert_docs", """SELECT path, CASE WHEN quality = 1 THEN 'old '||path ELSE text END AS text
    FROM docs WHERE NOT coalesce(quality = 1 AND toxic = 1, false)""")
on_corpus("write_report", report("""SELECT k, response AS text FROM responses
    WHERE response LIKE 'Sugg%'"""))
sql("write_index", index_files(INDEX), PARTS)
sql("append_section", f"""SELECT CASE WHEN s.page = 0 THEN 'index.md'
        ELSE 'index.media-'||(s.page + 1)||'.md' END AS path,
    CASE WHEN s.page = 0 THEN i.text||s.text ELSE s.text END AS text
    FROM ({index_files(INDEX)}) i, ({SECTION}) s WHERE i.path = 'index.md'""", PARTS, MEDIA)

# --- whole runs ------------------------------------------------------------

on_corpus("harvest_run", f"""SELECT path, CASE WHEN quality = 1 THEN 'old '||path
    ELSE {staged('path', 'text')} END AS text FROM docs WHERE path LIKE 'docs/%'""")


def role_replies(only: str) -> str:
    return f"""replies AS (SELECT rol, {answer('n')} AS response FROM (
        SELECT rol, length({role_prompt("'roles/'||rol", 'sections')}) AS n
        FROM sectioned WHERE {only})),
    everything AS (SELECT 'other' AS cat, rol FROM replies WHERE response IS NOT NULL),
    titles AS (SELECT DISTINCT cat, {lit(DEFAULT_CATEGORY_TITLE)} AS title, '' AS description
        FROM everything WHERE cat = {lit(DEFAULT_CATEGORY)})"""


ROLE_DOCS = f"""SELECT 'roles/'||rol||'.md' AS path, {role_doc('rol', 'response')} AS text
    FROM replies WHERE response IS NOT NULL"""
SMALL_INDEX = index_files(index_sql(INDEX_TITLE, "", "", False))
on_corpus("ingest_run", f"{ROLE_DOCS} UNION ALL {SMALL_INDEX}", MEMBERS, role_replies(
    "rol IN (SELECT source FROM docs WHERE path LIKE 'roles/%' AND toxic = 1)"))
on_corpus("compile_run", f"""SELECT path, {answer('n')} AS text FROM (
    SELECT path, length({compile_prompt(truncated('text', 6000))}) AS n
    FROM docs WHERE path LIKE '%.md' AND coalesce(quality, 0) = 0) WHERE n % 11 <> 0""")
LINTED = "regexp_matches(lower(text), 'issue|missing|suggest')"


def findings(docs: str) -> str:
    n = f"length({lint_prompt(lit('wiki/') + '||path', truncated('text', 6000))})"
    return f"""SELECT * FROM (SELECT string_split(path, '/') AS k, {answer('n')} AS text FROM (
        SELECT path, {n} AS n FROM ({docs}))) WHERE {LINTED}"""


on_corpus("lint_run", report(findings(
    "SELECT * FROM docs WHERE path LIKE '%.md' AND coalesce(quality, 0) = 0")))
sql("index_run", f"""SELECT 'roles/'||rol||'.md' AS path, 'doc of '||rol AS text FROM active
    UNION ALL {index_files(INDEX)}""", PARTS)
COMPILED = f"""SELECT path, {answer('n')} AS text FROM (
    SELECT path, length({compile_prompt(truncated('staged', 6000))}) AS n FROM (
    SELECT path, {staged('path', 'text')} AS staged FROM docs WHERE path LIKE 'docs/%'))
    WHERE n % 11 <> 0"""
on_corpus("converge_run", f"""SELECT * FROM published
    UNION ALL SELECT 'report '||page, text FROM ({report(findings('SELECT * FROM published'))})""",
          MEMBERS, role_replies("true"),
          f"published AS ({ROLE_DOCS} UNION ALL {SMALL_INDEX} UNION ALL {COMPILED})")
