"""All queries of the engine's own operators, and the SQL that checks them."""

from __future__ import annotations

from spanwright.plans import extras, grid, ledger, logs, records, relations, retrieval, study, texts

FLAGSHIP = "i8_metrics_by_label"
MODULES = (retrieval, texts, study, extras, ledger, logs, grid, records, relations)
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
