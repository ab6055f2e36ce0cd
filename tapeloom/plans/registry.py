"""All registered queries of the market time-series engine, and their SQL."""

from __future__ import annotations

from tapeloom.plans import book, controls, facts, feeds, healing, live, market, records, setups, streams, views, walks

_MODULES = (market, facts, records, setups, streams, views, walks, book, feeds, live, healing, controls)

QUERIES = {name: f for m in _MODULES for name, f in m.R.queries.items()}
ORACLE_SQL = {name: text for m in _MODULES for name, text in m.R.sql.items()}
