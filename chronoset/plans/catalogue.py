"""The registered queries and their SQL."""

from __future__ import annotations

from chronoset.plans import rule_queries, run_queries, study_queries, summary_queries, tree_queries

MODULES = (study_queries, tree_queries, rule_queries, summary_queries, run_queries)
QUERIES: dict = {}
ORACLE: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
