"""Rows that extraction yields: an entity has a label, a relationship a type."""

from __future__ import annotations

ROW = "entity string, label string, kind string, name string, rel_type string, target string, line_start int, line_end int, docstring string, signature string"


def entity(qn: str, label: str, kind: str, name: str, start: int = 0, end: int = 0, doc: str | None = None, signature: str = "") -> tuple:
    return qn, label, kind, name, "", "", start, end, doc, signature or None


def relation(source: str, rel_type: str, target: str, line: int = 0) -> tuple:
    return source, "", "", "", rel_type, target, line, 0, None, None
