"""Rules found by what a path must contain, so that most of them are never tried.

A rule with a literal name (or a plain ``*.ext``) is filed under it, unless many rules share that name.
Any other rule is filed under one *gram*, a few characters of its literal text: whichever path it
matches has that gram. Grams have the lengths of ``GRAMS``; a rule without literal text has the
empty one, which every path has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd

from corpusmill.functions.rules import Rule, wildmatch_rule

GRAMS = (8, 4, 2, 1)
OFFERED = 64  # grams of a rule to choose from; any of them would do
SHARED = 16  # rules that a name may have before their other text is used instead


def grams_of(rule: Rule) -> list[str]:
    """The grams a rule can be filed under, of all its literal runs besides its name; none if it
    has a name and nothing else."""
    runs = [f for f in rule.fragments if f != rule.token and "*" + f != rule.token]
    if not runs:
        return [] if rule.token else [""]
    every: dict[str, None] = {}
    for run in runs:
        size = next(n for n in GRAMS if n <= len(run))
        every.update((run[i:i + size], None) for i in range(len(run) - size + 1))
    return list(every)[::-(-len(every) // OFFERED)]


def python_regex(java: str) -> str:
    """The same expression for Python: another end mark, other hexadecimal escapes."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}",
                  java.removesuffix("\\z")) + r"\Z"


class RuleSet:
    """The rules of one file, from first to last; the last one that matches decides."""

    def __init__(self, rules: list[Rule]):
        rules = list({r.regex: r for r in reversed(rules)}.values())  # last one first, each once
        sharing = Counter(r.token for r in rules)
        grams = [grams_of(r) if not r.token or sharing[r.token] > SHARED else [] for r in rules]
        common = Counter(g for offered in grams for g in offered)
        self.names: dict[str, list[int]] = {}
        self.grams: dict[str, list[int]] = {}
        for i, (rule, offered) in enumerate(zip(rules, grams)):
            if offered:
                gram = min(offered, key=lambda g: common[g])
                self.grams.setdefault(gram, []).append(i)
            else:
                self.names.setdefault(rule.token, []).append(i)
        self.sizes = sorted({len(g) for g in self.grams})
        self.rules = rules
        self.compiled: dict[int, re.Pattern] = {}

    def candidates(self, path: str) -> list[int]:
        """Rules that may match, the last one of the file first."""
        found: set[int] = set()
        for part in path.split("/"):
            found.update(self.names.get(part, ()))
            if "." in part:
                found.update(self.names.get("*" + part[part.rindex("."):], ()))
        for size in self.sizes:
            grams = {path[i:i + size] for i in range(len(path) - size + 1 if size else 1)}
            for gram in grams & self.grams.keys():
                found.update(self.grams[gram])
        return sorted(found)

    def verdict(self, path: str) -> bool | None:
        """Whether the rule that decides is a ``!`` rule; None if no rule matches."""
        for i in self.candidates(path):
            if i not in self.compiled:
                self.compiled[i] = re.compile(python_regex(self.rules[i].regex))
            if self.compiled[i].match(path):
                return self.rules[i].negated
        return None


def judge_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by rule file, its rules first and then the paths it may speak of; a file's rules
    are made into one ``RuleSet`` when its first path comes."""
    key, lines, ready = None, [], None
    for batch in batches:
        out = []
        for base, salt, is_path, pattern, path, depth in batch.itertuples(index=False, name=None):
            if (base, salt) != key:
                key, lines, ready = (base, salt), [], None
            if not is_path:
                lines.append(pattern)
                continue
            if ready is None:
                ready = RuleSet([r for r in map(wildmatch_rule, lines) if r])
            negated = ready.verdict(path[len(base) + 1:] if base else path)
            if negated is not None:
                out.append((path, depth, negated))
        yield pd.DataFrame(out, columns=["path", "depth", "negated"])
