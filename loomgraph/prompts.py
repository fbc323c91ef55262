"""Prompt templates by name, and reading more of them from Markdown."""

from __future__ import annotations

import re
import string

TEMPLATES = {
    "tasks": "Split this part of a coding conversation into one to five tasks.\n$chunks\n\nReply with JSON: chunk_summaries (chunk_id, summary) and tasks (task_label, task_summary, chunk_ids).",
    "triples": "List three to eight facts from this task as JSON: triples (head, relation, tail, confidence from 0 to 1).\n$task",
    "entities": "List the named things in this task as a JSON array of strings.\n$task",
    "merge": "Do these two names mean the same thing? Reply yes or no.\n$a\n$b",
    "query_entities": "Which named things does this question ask about? Reply with a JSON array of strings.\n$query",
    "summary": "Summarise what was done about: $query\n\n$sources",
    "skeleton": "Write a summary of $topic along these sections.\n$sections",
}
_FENCE = re.compile(r"^#+\s*(?P<name>[\w-]+)\s*\n+```\w*\n(?P<body>.*?)\n```", re.M | re.S)


def read_markdown(source: str) -> dict[str, str]:
    """Templates of a Markdown document: each fenced block under a heading that is one word."""
    return {m["name"]: m["body"] for m in _FENCE.finditer(source)}


def render(name: str, templates: dict[str, str] | None = None, **values: str) -> str:
    return string.Template((TEMPLATES | (templates or {}))[name]).substitute(values)
