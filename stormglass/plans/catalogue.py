"""All registered queries."""

from __future__ import annotations

from . import landed, macro, panel, results, scorecards, scoring, shared_fits
from .spec import Query


def all_queries() -> dict[str, Query]:
    found = [q for part in (macro, panel, scoring, results, scorecards, shared_fits, landed) for q in part.queries()]
    names = [q.name for q in found]
    if len(set(names)) != len(names):
        raise ValueError("two queries share a name")
    return dict(zip(names, found))


def entry_query() -> Query:
    """The flagship: the composite index with its trends for every entity and month."""
    return all_queries()["c3_stress_index"]
