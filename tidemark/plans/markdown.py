"""Plain Markdown for reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any


def shown(value: Any) -> str:
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, Mapping):
        return ", ".join(f"{k}: {shown(v)}" for k, v in value.items()) or "none"
    if isinstance(value, list | tuple):
        return ", ".join(map(shown, value)) or "none"
    return str(value)


def table(rows: Sequence[Mapping], columns: Sequence[str]) -> list[str]:
    """A table of the given columns; a line that says so if there are no rows."""
    if not rows:
        return ["none"]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(columns), "|" + "---|" * len(columns), *(line([shown(r.get(c)) for c in columns]) for r in rows)]


def facts(values: Mapping, *names: str) -> list[str]:
    """A list of named values, all of them if none is named."""
    return [f"- {n}: {shown(values.get(n))}" for n in names or values]


def page(title: str, sections: Mapping[str, Sequence[str]], closing: str = "") -> str:
    lines = [f"# {title}", ""]
    for name, body in sections.items():
        lines += [f"## {name}", "", *body, ""]
    return "\n".join([*lines, closing, ""] if closing else lines)


def remarks(found: Sequence[Mapping]) -> list[str]:
    return [f"- **{w['severity']} {w['code']}**: {w['message']}" for w in found] or ["none"]
