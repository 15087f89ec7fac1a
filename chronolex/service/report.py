"""An HTML report of one comparison: its theme changes, orphaned and new themes, quotes and quality gates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from html import escape
from typing import Any

#: Gates of an extraction's quality: agreement of two runs, share of verified quotes, high shifts of a document against itself.
GATES = {"consistency": 0.90, "verified": 1.0, "control": 0}


def gates(consistency: float, verified: float, control: int) -> dict[str, bool]:
    return {"consistency": consistency >= GATES["consistency"], "verified": verified >= GATES["verified"], "control": control <= GATES["control"]}


def _table(rows: list[Mapping[str, Any]]) -> str:
    if not rows:
        return "<p>None.</p>"
    names = list(rows[0])
    head = "".join(f"<th>{escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(r.get(n, '')))}</td>" for n in names) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def html_report(title: str, summary: str, sections: Mapping[str, Iterable[Mapping[str, Any]]], passed: Mapping[str, bool] | None = None) -> str:
    """A page of a heading, the summary, the gates and a table per section."""
    parts = [f"<h1>{escape(title)}</h1><p>{escape(summary)}</p>"]
    if passed:
        parts.append("<ul>" + "".join(f"<li>{escape(k)}: {'passed' if v else 'failed'}</li>" for k, v in passed.items()) + "</ul>")
    parts += [f"<h2>{escape(name)}</h2>{_table(list(rows))}" for name, rows in sections.items()]
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body>{"".join(parts)}</body></html>'
