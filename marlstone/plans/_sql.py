"""Pieces of SQL that the stated results share. The dialect is DuckDB's."""
from __future__ import annotations

from ..functions.rules import WS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def join(xs: str, gap: str = "\n") -> str:
    return f"coalesce(array_to_string({xs}, {lit(gap)}), '')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def sentences(x: str) -> str:
    """Cut after . or ; before white space."""
    return rf"string_split(regexp_replace({x}, '([.;])[{WS}]+', '\1' || chr(1), 'g'), chr(1))"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def labels(low: str, table, default: str) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN {any_of(low, words)} THEN {lit(label)} END" for label, words in table) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{lit(default)}] END"
