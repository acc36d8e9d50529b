"""Path rules: patterns become Java regexes on the driver, predicates stay columns.

Three dialects share one segment translator: ignore files (``wildmatch_rule``), shell
names (``fnmatch_regex``, ``path_match_regex``) and recursive globs (``rglob_regex``).
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.paths import base_name, components


class Rule(NamedTuple):
    regex: str
    negated: bool
    token: str | None
    fragments: tuple[str, ...] = ()  # what any path that matches must contain


def _char_class(body: str, escapes: bool) -> tuple[list[str], int] | None:
    """Members of the bracket expression ``body`` opens, and where it ends."""
    i, members, first = 0, [], True
    while i < len(body):
        ch = body[i]
        if ch == "]" and not first:
            return members, i + 1
        first = False
        if escapes and ch == "\\" and i + 1 < len(body):
            i += 1
            ch = body[i]
        if body[i + 1:i + 2] == "-" and body[i + 2:i + 3] not in ("", "]"):
            hi, skip = body[i + 2], 3
            if escapes and hi == "\\" and i + 3 < len(body):
                hi, skip = body[i + 3], 4
            if ch <= hi:
                members.append(f"\\x{{{ord(ch):x}}}-\\x{{{ord(hi):x}}}")
            i += skip
        else:
            members.append(f"\\x{{{ord(ch):x}}}")
            i += 1
    return None


def _segment(glob: str, any_char: str, escapes: bool) -> str:
    """Regex for wildcards inside one name. ``any_char`` is what ``?`` may stand for."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            while glob[i:i + 1] == "*":
                i += 1
            out.append(any_char + "*")
        elif ch == "?":
            out.append(any_char)
        elif ch == "[":
            negated = glob[i:i + 1] == "!" or (escapes and glob[i:i + 1] == "^")
            found = _char_class(glob[i + negated:], escapes)
            if found is None:
                out.append("\\[")
                continue
            members, used = found
            i += negated + used
            guard = "(?!/)" if any_char != "." else ""
            if not members:
                out.append(any_char if negated else "(?!)")
            else:
                out.append(f"{guard}[{'^' if negated else ''}{''.join(members)}]")
        elif ch == "\\" and escapes and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        else:
            out.append(re.escape(ch))
    return "".join(out)


def _join_segments(segments: list[str], escapes: bool) -> str:
    """Regex for '/'-joined segments where ``**`` spans directories."""
    segments = [s for i, s in enumerate(segments) if s != "**" or segments[i - 1:i] != ["**"]]
    out, glue = "^", ""
    for i, seg in enumerate(segments):
        last = i == len(segments) - 1
        if seg == "**":
            if last:
                out += glue + ".+"
            elif i == 0:
                out += "(?:.+/)?"
            else:
                out += "/(?:.+/)?"
            glue = ""
        else:
            out += glue + ("[^/]+" if seg == "*" else _segment(seg, "[^/]", escapes))
            glue = "/"
    return out


def _literal(segment: str) -> str | None:
    """The exact name a segment stands for, or ``*.ext`` for a plain suffix rule."""
    if not re.search(r"[*?\[\\]", segment):
        return segment
    suffix = re.fullmatch(r"\*+([^*?\[\\]*)", segment)
    if suffix and "." in suffix[1]:
        return "*" + suffix[1][suffix[1].rindex("."):]
    return None


def literal_runs(glob: str) -> list[str]:
    """The runs of characters that stand for themselves in one segment of an ignore-file line."""
    runs, i = [""], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "[":
            start = i + (glob[i:i + 1] in ("!", "^"))
            found = _char_class(glob[start:], True)
            if found:
                i, ch = start + found[1], ""
        elif ch == "\\" and i < len(glob):
            ch = glob[i]
            i += 1
        elif ch in "*?":
            ch = ""
        runs[-1] += ch
        if not ch:
            runs.append("")
    return [r for r in runs if r]


def wildmatch_rule(line: str | None) -> Rule | None:
    """One ignore-file line. None for nulls, blanks, comments and a lone slash."""
    if line is None:
        return None
    text = line.lstrip() if line.endswith("\\ ") else line.strip()
    if not text or text.startswith("#") or text == "/":
        return None
    negated = text.startswith("!")
    if negated:
        text = text[1:]
    below_only = text.endswith("/")
    body = text[:-1] if below_only else text
    anchored = "/" in body
    segments = body[1:].split("/") if body.startswith("/") else body.split("/")
    if not anchored and segments != ["**"]:
        segments = ["**", *segments]
    tail = "/.+" if below_only else "" if segments[-1] == "**" else "(?:/.+)?"
    names = [n for n in map(_literal, segments) if n]
    token = max(names, key=lambda n: (not n.startswith("*"), len(n))) if names else None
    fragments = tuple(run for s in segments if s != "**" for run in literal_runs(s))
    return Rule("(?s)" + _join_segments(segments, True) + tail + "\\z", negated, token, fragments)


def fnmatch_regex(pattern: str) -> str:
    return "(?s)^" + _segment(pattern, ".", False) + "\\z"


def path_match_regex(pattern: str) -> str | None:
    """Right-anchored component match; ``**`` is one component here. A pattern that starts
    at the root never matches a relative path."""
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    if pattern.startswith("/") or not parts:
        return None
    names = ["[^/]+" if set(p) == {"*"} else _segment(p, "[^/]", False) for p in parts]
    return "(?s)(?:^|/)" + "/".join(names) + "\\z"


def rglob_regex(pattern: str, root_only: bool = False) -> str:
    """Recursive discovery: the pattern may start at any depth, also a ``./`` one.
    ``root_only`` pins ``./`` patterns to the root instead."""
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    start = [] if root_only and pattern.startswith("./") else ["**"]
    return "(?s)" + _join_segments(start + parts, False) + "\\z"


def any_of(value: Column, regexes: list[str]) -> Column:
    """One alternation, so a long list costs one pass over the path."""
    unique = list(dict.fromkeys(r for r in regexes if r))
    return value.rlike("|".join(f"(?:{r})" for r in unique)) if unique else F.lit(False)


def matches_patterns(path: Column, patterns: list[str], root_only: bool = False) -> Column:
    return any_of(path, [rglob_regex(p, root_only) for p in patterns])


def sign_runs(rules: list[Rule]) -> list[tuple[bool, list[str]]]:
    """Neighbouring rules of one sign, as (negated, regexes): they can share a regex."""
    runs: list[tuple[bool, list[str]]] = []
    for rule in rules:
        if runs and runs[-1][0] == rule.negated:
            runs[-1][1].append(rule.regex)
        else:
            runs.append((rule.negated, [rule.regex]))
    return runs


def ignored_wildmatch(path: Column, patterns: list[str]) -> Column:
    """Last matching rule wins; ``!`` rules take a path back in."""
    rules = [r for r in map(wildmatch_rule, patterns) if r]
    verdicts = [F.when(any_of(path, regexes), F.lit(not negated))
                for negated, regexes in reversed(sign_runs(rules))]
    return F.coalesce(*verdicts, F.lit(False))


def ignored_by_name(path: Column, patterns: list[str]) -> Column:
    """Second predicate of the compatible mode; it knows no negation."""
    return (any_of(base_name(path), [fnmatch_regex(p) for p in patterns])
            | any_of(path, [path_match_regex(p) for p in patterns]))


def is_ignored(path: Column, patterns: list[str], mode: str = "compat") -> Column:
    """``compat`` ORs both predicates, so ``!`` rules lose to a name match; ``strict``
    keeps to the ignore-file meaning."""
    if mode == "strict":
        return ignored_wildmatch(path, patterns)
    return ignored_wildmatch(path, patterns) | ignored_by_name(path, patterns)


def ignored_by_substring(path: Column, patterns: list[str]) -> Column:
    inside = [F.contains(path, F.lit(p)) for p in patterns]
    return reduce(lambda a, b: a | b, inside, any_of(path, [fnmatch_regex(p) for p in patterns]))


def in_output_trees(path: Column, dirs: list[str]) -> Column:
    """Below an output directory, or with a component of that name at any depth."""
    hit = F.lit(False)
    for name in dirs:
        hit = hit | F.startswith(path, F.lit(name + "/")) \
            | F.array_contains(components(path), name)
    return hit


def is_named(path: Column, name: str) -> Column:
    return base_name(path) == name
