"""The facade: one store, one embedder, and all retrieval."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, relational
from ..sources import files as files_
from ..sources.query_cache import QueryCache
from ..sources.store import VERSION, Store
from . import extract, ingest, packing
from .retrieval import Planner

log = logging.getLogger(__name__)


class Engine:
    """Index files, refresh vectors, and answer. Use as a context manager, or close it.

    Parts that can be replaced: ``embed`` (column to column; ``ingest.batched``
    makes one of a function of lists), ``extractor`` (files to rows, as
    ``extract.extracted``), ``serialize`` (nodes and edges to texts), ``router``
    and ``rank`` (see ``Planner``), and the ``cache`` of query vectors.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] | None = None, model: str = "hashing", dim: int = 256, router=None, weights: ranking.Weights | None = None, cache: QueryCache | None = None, now: float | None = None, extractor: Callable[[DataFrame], DataFrame] = extract.extracted, serialize: Callable[[DataFrame, DataFrame], DataFrame] = ingest.texts, rank: Callable[..., DataFrame] = ranking.hybrid):
        self.spark, self.store = spark, Store(spark, path)
        self.embed, self.model, self.dim = embed or ingest.hashing(dim), model, dim
        self.router, self.weights, self.now = router, weights, now
        self.extractor, self.serialize, self.rank = extractor, serialize, rank
        self.cache = cache if cache is not None else QueryCache(model, dim)
        self._graph = None
        self._closed = False
        had = self.store.get_meta("embedder")
        if had and had != [model, dim]:
            log.warning("vectors were made by %s; refresh them all for %s", had, [model, dim])
        self.cache.reconcile(model, dim)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        self._closed = True

    @property
    def graph(self):
        if self._closed:
            raise RuntimeError("the engine is closed")
        if self._graph is None:
            self._graph = self.store.load()
        return self._graph

    def _save(self, graph, **meta) -> None:
        self.store.save(graph, meta)
        self._graph = None

    def index(self, root: str | DataFrame, embed: bool = True, force: bool = False) -> ingest.Report:
        """Take in a folder, or a DataFrame of files."""
        source = root if isinstance(root, DataFrame) else files_.read(self.spark, root)
        graph, report = ingest.index(self.graph, source, force, self.extractor)
        if report.files_indexed or report.files_deleted:
            self._save(graph)
        if embed:
            report.embedded = self.refresh_embeddings()
        return report

    def refresh_embeddings(self, full: bool = False) -> int:
        graph, n = ingest.refresh(self.graph, self.embed, self.model, full, self.serialize)
        if n:
            self._save(graph, embedder=[self.model, self.dim])
        return n

    def rebuild_vector_index(self) -> int:
        """0: the scan reads the stored vectors, so there is no derived index that could drift from them."""
        return 0

    def clear_query_cache(self) -> None:
        self.cache.clear()

    def dump_query_cache(self, path: str) -> int:
        """Write the cached query vectors to a file; how many."""
        return self.cache.dump(path)

    def load_query_cache(self, path: str) -> int:
        """Add the query vectors of a file; how many. A file of another model or dimension adds none."""
        return self.cache.load(path)

    def query_vector(self, query: str) -> list[float]:
        got = self.cache.get(query)
        if got is None:
            got = [float(x) for x in self.spark.range(1).select(self.embed(F.lit(query)).alias("v")).first().v]
            self.cache.put(query, got)
        return got

    @property
    def planner(self) -> Planner:
        return Planner(self.graph, self.query_vector, self.router, self.weights, self.now, self.rank)

    def ask(self, query: str, k: int = 5, depth: int = 2, as_context: bool = False, budget_tokens: int = 2000):
        got = self.planner.retrieve(query, k, depth)
        return packing.pack(got, budget_tokens) if as_context else got

    def locate(self, symbol: str) -> list[dict]:
        return [r.asDict() for r in relational.references_to(self.graph.nodes, self.graph.edges, symbol).collect()]

    def explain(self, query: str, k: int = 5, depth: int = 2) -> dict:
        return self.planner.explain(query, k, depth)

    def filter(self, wanted: dict, k: int = 5) -> dict:
        return self.planner.filter(wanted, k)

    def context(self, query: str, k: int = 5, depth: int = 2, budget_tokens: int = 2000) -> packing.Packed:
        return packing.pack(self.explain(query, k, depth), budget_tokens)

    def status(self) -> dict:
        g = self.graph
        return {"nodes": g.nodes.count(), "edges": g.edges.count(), "embeddings": g.embeddings.count(), "dirty": g.nodes.where("embed_dirty").count(), "pending": g.pending.count(), "schema": VERSION, "embedder": self.store.get_meta("embedder")}
