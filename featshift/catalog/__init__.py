"""All registered queries, by area."""

from __future__ import annotations

from importlib import import_module

from featshift.catalog.base import Query

AREAS = ("preparation", "corruption", "scoring", "curves", "locating", "logistic", "distances", "correcting")


def all_queries() -> list[Query]:
    found: list[Query] = []
    for area in AREAS:
        found.extend(import_module(f"featshift.catalog.{area}").QUERIES)
    names = [q.name for q in found]
    if len(set(names)) != len(names):
        raise ValueError("query names must be unique")
    return found
