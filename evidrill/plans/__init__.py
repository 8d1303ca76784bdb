"""Registered queries. Each module has QUERIES, by name, and SQL with what another engine should find."""

from __future__ import annotations

from . import audits, contracts, decide, enrich, imports, ledger, reviews, scores, social, texts

MODULES = (scores, ledger, reviews, texts, decide, imports, contracts, social, enrich, audits)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
