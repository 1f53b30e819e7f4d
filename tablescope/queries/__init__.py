"""Registered queries: name -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from . import augment, charts, judge, prep, profiling, search, sources

REGISTRY: dict = {}
for _module in (profiling, judge, prep, augment, charts, search, sources):
    REGISTRY.update(_module.QUERIES)
