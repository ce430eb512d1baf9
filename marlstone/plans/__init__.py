"""The registered queries of the library, each with the SQL that states its result where SQL can."""
from __future__ import annotations

from importlib import import_module

#: Modules of this package that register queries.
PARTS = ("cleaning", "chunking", "retrieval", "qa", "sinks", "evaluation")


def _merged(name: str) -> dict:
    out: dict = {}
    for part in PARTS:
        out |= getattr(import_module(f"{__name__}.{part}"), name)()
    return out


def queries() -> dict:
    return _merged("queries")


def oracle_sql() -> dict[str, str]:
    return _merged("oracle_sql")
