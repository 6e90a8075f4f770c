"""All checked queries and their SQL twins."""

from __future__ import annotations

from lagwise.plans import catalog_panel, catalog_results

QUERIES = {**catalog_panel.QUERIES, **catalog_results.QUERIES}
ORACLES = {**catalog_panel.ORACLES, **catalog_results.ORACLES}
