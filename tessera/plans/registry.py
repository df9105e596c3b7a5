"""Names every query of the engine and its SQL twin."""

from __future__ import annotations

from . import experiment, jobs, models, rag, relational, sessions, streams, tabular, text

MODULES = (sessions, relational, rag, experiment, tabular, text, models, streams, jobs)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
