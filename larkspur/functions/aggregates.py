"""Aggregates that Spark names otherwise."""

from __future__ import annotations

TEMPLATES = {
    "total": lambda x: f"coalesce(sum(cast({x} AS double)), 0.0D)",
    "group_concat": lambda x, sep="','": f"listagg(cast({x} AS string), {sep})",
    "count": lambda *xs: f"count({', '.join(xs) if xs else '*'})",
}
