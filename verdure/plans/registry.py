"""All registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a callable of (spark, sf_dir) under a name, with DuckDB SQL for the same rows if there is any."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


from . import q_bands, q_catalog, q_edits, q_learn, q_match, q_raster, q_recipes, q_sources, q_zonal  # noqa: E402, F401
