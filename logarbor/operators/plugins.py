"""Analysis plugins: named functions entries -> {result name: DataFrame}.

A plugin is declarative: it returns DataFrames built from ``entries`` (per-row
accumulation becomes groupBy/agg). A plugin that has to see the entries one by one
keeps a mergeable state by key: see ``accumulators``. The built-in plugin is the
error-cluster analysis.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from logarbor.operators.clusters import error_clusters, error_clusters_by_service

Plugin = Callable[[DataFrame], dict[str, DataFrame]]

_REGISTRY: dict[str, Plugin] = {}


def register(name: str, plugin: Plugin) -> None:
    _REGISTRY[name] = plugin


def registered() -> dict[str, Plugin]:
    return dict(_REGISTRY)


def error_cluster_plugin(entries: DataFrame) -> dict[str, DataFrame]:
    by_service = error_clusters_by_service(entries)
    return {
        "top_error_patterns": error_clusters(entries, 10, by_service),
        "service_errors": by_service,
    }


register("ErrorClusterPlugin", error_cluster_plugin)


def run_plugins(entries: DataFrame, names: list[str] | None = None) -> dict[str, dict[str, DataFrame]]:
    chosen = _REGISTRY if names is None else {n: _REGISTRY[n] for n in names}
    return {name: plugin(entries) for name, plugin in chosen.items()}
