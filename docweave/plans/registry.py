"""Every registered query of the document-structuring operators and its SQL twin."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, and the SQL that gives the same rows."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return register


for module in ("sources", "tokens", "lines", "layout", "headings", "entries", "linerules", "fields", "records", "alignment", "metrics", "streams", "projects", "rulepacks"):
    importlib.import_module(f"docweave.plans.{module}_queries")
