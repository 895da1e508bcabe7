"""Snapshots: a folder for each version, and a pointer that is replaced last.

A version is whole or not there, so a failed job leaves the old one. Paths go
through Arrow's file systems, as Spark's do through its own.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph as G

VERSION = 1
TABLES = {"nodes": G.NODES, "edges": G.EDGES, "embeddings": G.EMBEDDINGS, "pending": G.PENDING}
#: Upgrades by the version they start from: all tables as they were written, to all tables of the next version.
STEPS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files, self.at = fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + os.path.abspath(self.root))
        self.files.create_dir(self.at, recursive=True)
        if self.state()["version"] > VERSION:
            raise RuntimeError(f"store has version {self.state()['version']}, newer than {VERSION}")
        self.migrate()

    def state(self) -> dict:
        """Pointer content; an empty store before the first snapshot."""
        info = self.files.get_file_info(f"{self.at}/CURRENT")
        if info.type == fs.FileType.NotFound:
            return {"version": VERSION, "snapshot": None, "meta": {}}
        with self.files.open_input_stream(f"{self.at}/CURRENT") as f:
            return json.loads(f.read())

    def _point(self, state: dict) -> None:
        part = f"{self.at}/CURRENT.{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(state).encode())
        self.files.move(part, f"{self.at}/CURRENT")

    def migrate(self) -> int:
        """Take an older store up to VERSION; the version it has then.

        Each step writes a snapshot and points to it with its version, so a step
        that fails leaves the store whole at the version before.
        """
        while (state := self.state())["version"] < VERSION:
            step = STEPS[state["version"]]
            snap = None
            if state["snapshot"]:
                snap = f"snap-{uuid.uuid4().hex}"
                for t, df in step({t: self.spark.read.parquet(f"{self.root}/{state['snapshot']}/{t}") for t in TABLES}).items():
                    df.write.parquet(f"{self.root}/{snap}/{t}")
            self._point({"version": state["version"] + 1, "snapshot": snap, "meta": state["meta"]})
        return self.state()["version"]

    def load(self) -> G.Graph:
        snap = self.state()["snapshot"]
        read = lambda t: self.spark.read.schema(TABLES[t]).parquet(f"{self.root}/{snap}/{t}") if snap else self.spark.createDataFrame([], TABLES[t])
        return G.Graph(*(read(t) for t in TABLES))

    def save(self, graph: G.Graph, meta: dict | None = None) -> None:
        """Write a new snapshot, then point to it. Columns are put in order; missing ones are null."""
        snap = f"snap-{uuid.uuid4().hex}"
        for t in TABLES:
            df = getattr(graph, t)
            want = self.spark.createDataFrame([], TABLES[t]).schema
            if df is None:
                df = self.spark.createDataFrame([], want)
            cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields]
            df.select(*cols).write.parquet(f"{self.root}/{snap}/{t}")
        state = self.state()
        self._point({"version": VERSION, "snapshot": snap, "meta": state["meta"] | (meta or {})})

    def get_meta(self, key: str, default=None):
        return self.state()["meta"].get(key, default)

    def set_meta(self, key: str, value) -> None:
        state = self.state()
        state["meta"][key] = value
        self._point(state)
