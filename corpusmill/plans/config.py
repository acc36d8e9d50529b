"""Settings of a run: defaults, and a one-level-deep override."""

from __future__ import annotations

from corpusmill.operators.rollup import DEFAULT_CATEGORY, DEFAULT_CATEGORY_TITLE, INDEX_TITLE
from corpusmill.sources.files import HARVEST_IGNORE, HARVEST_PATTERNS

# Folder names, size bounds, generation parameters and prompt texts.
DEFAULTS = {
    "wiki_dir": "wiki",
    "wiki_state_dir": ".wiki",
    "harvest_rglob_patterns": HARVEST_PATTERNS,
    "harvest_ignore": HARVEST_IGNORE,
    "ingest_ignore": [],
    "title": INDEX_TITLE,
    "subtitle": "",
    "description": "",
    "default_category": DEFAULT_CATEGORY,
    "default_category_title": DEFAULT_CATEGORY_TITLE,
    "priority_roles": [],
    "llm": {"temperature": 0.25, "max_tokens": 4096, "timeout": 1200},
    "role_prompt": {
        "prefix": "You are an expert Ansible architect and excellent technical writer.\n"
                  "Create a comprehensive, high-quality, professional documentation page.",
        "suffix": "Important notes:\n- Double-underscore variables are internal only.\n"
                  "- Do not invent Related Roles.\n- Use only standard GitHub Markdown.",
    },
    "compile_prompt": {
        "prefix": "You are an expert technical writer.\n"
                  "Improve and standardize this documentation page for GitHub rendering.",
        "suffix": "Keep all original information. Add proper YAML frontmatter, categories, "
                  "and a Backlinks section if missing.\nOutput only the improved Markdown.",
    },
    "lint_prompt": {
        "prefix": "You are a strict technical documentation reviewer.\n"
                  "Analyze this documentation page for issues.",
        "suffix": "Return findings in this exact format:\n### {filename}\n**Issues:**\n"
                  "- issue 1\n**Suggestions:**\n- suggestion 1",
    },
}
SOURCE_TYPE = "legacy_markdown"
MAX_DOCUMENT_CHARS = 6000
MAX_MEMBER_CHARS = 2500


def load_config(override: dict | None = None) -> dict:
    """``override`` is a parsed configuration; its ``wiki`` entries replace whole defaults."""
    return {**DEFAULTS, **((override or {}).get("wiki") or {})}
