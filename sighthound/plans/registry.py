"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from . import checks, identity, joining, listing, reports, scalars, stored, tracking

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (reports, scalars, stored, tracking, joining, identity, checks, listing, stored):
    QUERIES.update({k: v[0] if isinstance(v, tuple) else v for k, v in _module.PLANS.items()})
    ORACLE_SQL.update({k: v[1] for k, v in _module.PLANS.items() if isinstance(v, tuple)})
