"""All queries and their SQL, from the modules that declare them."""

from __future__ import annotations

from quern.plans import audits, classification, corpus, matching, metrics, texts

MODULES = (texts, audits, corpus, matching, classification, metrics)
QUERIES = {name: function for module in MODULES for name, function in module.PLANS.queries.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.PLANS.sql.items()}
