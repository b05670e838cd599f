"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from paperloom.plans import corpus, evals, filings, ledger, repos, streams, user, web

_MODULES = [filings, corpus, ledger, evals, repos, web, streams, user]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
ORACLE["stored_gap_excerpts"] = ORACLE["gap_excerpts"]
