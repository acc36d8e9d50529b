"""Column expressions over document text. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character sets that Python's str.splitlines and str.strip use, the
# truncation marker, and the words that make a response a finding.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
SPACE = "\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TRUNCATION_MARKER = "\n... [truncated - large file] ..."
FINDING_WORDS = ("issue", "missing", "suggest")

# Expressions mention their argument as few times as they can: a Column has no variables, so
# every mention is another copy of the argument's expression in the plan.
_CASED = "\\p{IsUppercase}\\p{IsLowercase}\\p{Lt}"

# Characters whose title case is not their upper case: digraphs, ligatures, Georgian.
_TITLED = {c: c.title() for c in map(chr, range(0x80, 0xD800)) if c.title() != c.upper()} | {
    c: c.title() for c in map(chr, range(0xE000, 0x10000)) if c.title() != c.upper()}


def strip(text: Column) -> Column:
    """Trim Unicode whitespace: one pass over bytes, where a regex would try every position."""
    return F.btrim(text, F.lit(SPACES))


def _kept_lines(text: Column) -> Column:
    return F.filter(F.split(text, LINE_BREAK, -1),
                    lambda line: ~line.rlike(f"^[{SPACE}]*+(?:#|\\z)"))


def compact_lines(text: Column) -> Column:
    """Drop blank lines and ``#`` lines, keep indentation, join with newlines."""
    return F.array_join(_kept_lines(text), "\n")


def squeeze_lines(text: Column) -> Column:
    """``compact_lines`` with each line stripped and no separator between lines."""
    return F.array_join(F.transform(_kept_lines(text), strip), "")


def decode_text(content: Column) -> Column:
    """UTF-8 text with ``\\n`` newlines; null when the bytes are not UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    newline = F.lit("\n")
    return F.replace(F.replace(text, F.lit("\r\n"), newline), F.lit("\r"), newline)


def truncate_text(text: Column, max_chars: int) -> Column:
    """Texts longer than twice ``max_chars`` keep ``max_chars`` and a marker."""
    return F.when(
        F.length(text) > 2 * max_chars,
        F.concat(F.substring(text, 1, max_chars), F.lit(TRUNCATION_MARKER)),
    ).otherwise(text)


def title_case(name: Column) -> Column:
    """Underscores to spaces, then capitalise every run of cased letters (``2fa`` → ``2Fa``)."""
    runs = F.regexp_extract_all(
        F.replace(name, F.lit("_"), F.lit(" ")), F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    titled = F.create_map(*[F.lit(x) for pair in _TITLED.items() for x in pair])

    def capital(first: Column) -> Column:
        return F.when(first > F.lit("\x7f"), F.coalesce(
            F.try_element_at(titled, first), F.upper(first))).otherwise(F.upper(first))

    return F.array_join(
        F.transform(runs, lambda r: F.concat(
            capital(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def is_finding(response: Column, words: tuple[str, ...] = FINDING_WORDS) -> Column:
    return F.lower(response).rlike("|".join(map(re.escape, words)))


# The width at which YAML writers fold a string, the indent of what follows, the
# characters that only a double-quoted string can hold, and their escapes.
YAML_WIDTH, YAML_INDENT = 80, "  "
YAML_SPECIAL = "\\x00-\\x09\\x0b-\\x1f\\x7f-\\x84\\x86-\\x9f\\ufeff\\ufffe\\uffff"
YAML_ESCAPES = {
    "\0": "0", "\a": "a", "\b": "b", "\t": "t", "\n": "n", "\v": "v", "\f": "f", "\r": "r",
    "\x1b": "e", '"': '"', "\x85": "N", "\u2028": "L", "\u2029": "P"}


def _folded(text: Column, start: int) -> Column:
    """Break at the first single space past the width, then again on each line; ``start`` is
    the column at which the text begins. One regex, which goes on where it last matched."""
    first, later = YAML_WIDTH + 1 - start, YAML_WIDTH + 1 - len(YAML_INDENT)
    return F.regexp_replace(
        text, f"((?:^[^\n]{{{first},}}?|(?:\\G(?!^)|(?<=\n{YAML_INDENT}))[^\n]{{{later},}}?)"
        "(?<=[^ \n])) (?=[^ \n])", f"$1\n{YAML_INDENT}")


def _double_quoted(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, letter in YAML_ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    others = [*range(0x01, 0x20), *range(0x7F, 0xA0), 0xFEFF, 0xFFFE, 0xFFFF]
    for code in others:
        if chr(code) not in YAML_ESCAPES:
            escape = f"\\x{code:02X}" if code < 0x100 else f"\\u{code:04X}"
            out = F.replace(out, F.lit(chr(code)), F.lit(escape))
    return F.concat(F.lit('"'), out, F.lit('"'))


def yaml_string(value: Column, start: int = 0) -> Column:
    """A YAML string that begins in column ``start``: plain when that reads back as the same
    string, else in single quotes, or double ones for what is not printable. Long plain and
    single-quoted strings are folded at spaces; double-quoted ones stay on one line."""
    needs_quotes = value.rlike(
        "(?s)^\\s|\\s\\z|^\\z|^[-?:](?=\\s|\\z)|^[,\\[\\]{}#&*!|>'\"%@`]"
        "|:(?=\\s|\\z)|\\s#|^---|^\\.\\.\\."
        "|^(?:~|null|Null|NULL|true|True|TRUE|false|False|FALSE|yes|Yes|YES|no|No|NO"
        "|on|On|ON|off|Off|OFF|<<|=)\\z"
        "|^[-+]?(?:0|[1-9][0-9_]*|0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]+|[0-9][0-9_]*(?::[0-5]?[0-9])+"
        "|[0-9][0-9_]*\\.[0-9_]*(?:[eE][-+][0-9]+)?|\\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?"
        "|[0-9][0-9_]*(?::[0-5]?[0-9])+\\.[0-9_]*|\\.(?:inf|Inf|INF))\\z"
        "|^\\.(?:nan|NaN|NAN)\\z"
        "|^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"
        "|^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|[ \\t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}"
        "(?:\\.[0-9]*)?(?:[ \\t]*(?:Z|[-+][0-9]{1,2}(?::[0-9]{2})?))?\\z")
    breaks = "\n\x85\u2028\u2029"
    inner = F.regexp_replace(F.replace(value, F.lit("'"), F.lit("''")),
                             f"([{breaks}]+)", f"$1{YAML_INDENT}")
    inner = F.regexp_replace(inner, f"(?<![{breaks}])\n", "\n\n")
    quoted = F.concat(F.lit("'"), _folded(inner, start + 1), F.lit("'"))
    return (F.when(value.rlike(f"[{YAML_SPECIAL}]| [{breaks}]|[{breaks}] "),
                   _double_quoted(value))
            .when(needs_quotes | value.rlike(f"[{breaks}]"), quoted)
            .otherwise(_folded(value, start)))


def add_frontmatter(text: Column, fields: dict[str, Column]) -> Column:
    """Metadata block, keys in alphabetical order, before the text; the whole is stripped."""
    lines = [F.concat(F.lit(f"{key}: "), yaml_string(fields[key], len(key) + 2))
             for key in sorted(fields)]
    return strip(F.concat(
        F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), text))


def ensure_frontmatter(text: Column, role: Column, role_path: Column) -> Column:
    """Prepend a default role header unless the text already opens with ``---``."""
    header = F.concat(
        F.lit('---\ntitle: "'), title_case(role), F.lit(' Role"\nrole: '), role_path,
        F.lit("\ncategory: Roles\ntype: ansible-role\ntags: [ansible, role, "), role,
        F.lit("]\n---\n\n"))
    return F.when(
        text.rlike(f"^[{SPACE}]*+---"), text).otherwise(F.concat(header, text))


def fence_section(name: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), name, F.lit("\n```yaml\n"), body, F.lit("\n```"))


def render_link(name: Column, link: Column) -> Column:
    return F.concat(F.lit("- ["), name, F.lit("]("), link, F.lit(")"))


def render_priority_link(name: Column, link: Column) -> Column:
    return F.concat(F.lit("- **["), name, F.lit("]("), link, F.lit(")** — Core role"))


def _part(prompt: dict | None, key: str) -> Column:
    return F.lit((prompt or {}).get(key) or "")


def compile_prompt(text: Column, prompt: dict | None) -> Column:
    return F.concat(_part(prompt, "prefix"), F.lit("\n\nOriginal content:\n"), text,
                    F.lit("\n\n"), _part(prompt, "suffix"))


def lint_prompt(path: Column, text: Column, prompt: dict | None) -> Column:
    return F.concat(_part(prompt, "prefix"), F.lit("\n\nFile: "), path,
                    F.lit("\n\nContent:\n"), text, F.lit("\n\n"), _part(prompt, "suffix"))


def role_prompt(role_path: Column, sections: Column, prompt: dict | None) -> Column:
    return F.concat(_part(prompt, "prefix"), F.lit("\nRole Path: "), role_path,
                    F.lit("\n\n"), sections, F.lit("\n\n"), _part(prompt, "suffix"))
