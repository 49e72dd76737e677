"""All registered queries and their SQL twins, gathered from the query modules."""

from __future__ import annotations

from colsieve.plans import filters, protocols, results

_MODULES = (filters, protocols, results)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.C.queries.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.C.oracles.items()}
