"""Registered queries and their SQL."""

from __future__ import annotations

from annalist.plans import actions, chains, documents, drafts, evidence, governance, runs, sessions, texts, transcripts, workflow

_MODULES = (transcripts, documents, workflow, evidence, governance, texts, actions, sessions, chains, runs, drafts)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
