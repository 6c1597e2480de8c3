"""Every registered query of the engine, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


from . import decoder_queries, evidence_queries, frame_queries, lattice_queries, lexicon_queries, probability_queries, ranking_queries, segmentation_queries, tracker_queries, vision_queries  # noqa: E402, F401
