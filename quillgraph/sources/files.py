"""Source files as a DataFrame: (path, content, sha256, mtime).

Spark's own file sources leave out names that start with an underscore, which
Python packages need. So paths are listed through Arrow's file systems, and
tasks read the contents.
"""

from __future__ import annotations

import os

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED = frozenset(".git .hg .svn .idea .tox .venv venv node_modules site-packages __pycache__ .mypy_cache .pytest_cache .ruff_cache dist build".split())
MOST_BYTES = 1_000_000
SNIFF = 4096


def listed(root: str, suffixes: tuple[str, ...], ignored: frozenset[str] = IGNORED, most: int = MOST_BYTES) -> list[tuple[str, float]]:
    """(relative path, time of change) of files by name and size; ignored and hidden folders and links aren't entered."""
    uri = root if "://" in root else "file://" + os.path.realpath(root)
    files, base = fs.FileSystem.from_uri(uri)
    local = isinstance(files, fs.LocalFileSystem)
    if files.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    out, todo = [], [base]
    while todo:
        for x in files.get_file_info(fs.FileSelector(todo.pop())):
            if local and os.path.islink(x.path):
                continue
            if x.type == fs.FileType.Directory:
                if x.base_name not in ignored and not x.base_name.startswith("."):
                    todo.append(x.path)
            elif x.type == fs.FileType.File and x.size <= most and x.base_name.lower().endswith(suffixes):
                out.append((x.path[len(base.rstrip("/")) + 1 :], (x.mtime_ns or 0) / 1e9))
    return sorted(out)


def read(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py",), ignored: frozenset[str] = IGNORED, most: int = MOST_BYTES) -> DataFrame:
    """Files under ``root``. Files with a zero byte near their start, and files that can't be read, are left out."""
    uri = root if "://" in root else "file://" + os.path.realpath(root)
    rows = listed(root, suffixes, ignored, most)
    paths = spark.createDataFrame(rows, "path string, mtime double")
    parts = max(1, min(len(rows) // 50, 10_000))

    def load(frames):
        files, base = fs.FileSystem.from_uri(uri)
        for frame in frames:
            got = []
            for path, mtime in zip(frame["path"], frame["mtime"], strict=True):
                try:
                    with files.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        data = f.read()
                except OSError:
                    continue
                if b"\0" not in data[:SNIFF]:
                    got.append((path, data, mtime))
            yield pd.DataFrame(got, columns=["path", "content", "mtime"])

    loaded = paths.repartition(parts, "path").mapInPandas(load, "path string, content binary, mtime double")
    return loaded.select("path", "content", F.sha2("content", 256).alias("sha256"), "mtime")
