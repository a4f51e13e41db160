"""All queries of the core, with the SQL that each must agree with."""

from __future__ import annotations

from strataq.queries import answers, data, retrieval, trees

MODULES = [data, retrieval, trees, answers]
FLAGSHIP = "ctx_build"
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
