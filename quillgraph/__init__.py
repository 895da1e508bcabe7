"""Spark-native property-graph and vector retrieval engine."""

from importlib import import_module

__version__ = "0.1.0"

_WHERE = {
    "Engine": "plans.engine", "Planner": "plans.retrieval", "ModelRouter": "plans.retrieval", "Intent": "plans.retrieval",
    "Packed": "plans.packing", "pack": "plans.packing", "Report": "plans.ingest", "batched": "plans.ingest",
    "Store": "sources.store", "Graph": "sources.graph", "QueryCache": "sources.query_cache", "Weights": "operators.ranking",
}
__all__ = ["__version__", *_WHERE]


def __getattr__(name: str):
    # on demand, so that Python workers load only what they run
    if name in __all__:
        return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
