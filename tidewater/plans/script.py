"""Statements from a script, a JSON list or a single string."""

from __future__ import annotations

import json


def statements(text: str) -> list[str]:
    """A line that begins with ``insert`` begins a statement; blank lines and ``--`` lines are skipped."""
    if text.lstrip().startswith("["):
        return [str(x) for x in json.loads(text)]
    found: list[list[str]] = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("--"):
            continue
        if line.lower().startswith("insert") or not found:
            found.append([])
        found[-1].append(line)
    return [" ".join(x) for x in found]
