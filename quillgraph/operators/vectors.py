"""Vectors: normalising, exact cosine and top-k.

Scores are dot products of float32 vectors summed in float64, to 9 decimals. Inside a batch
they are one matrix product; each partition keeps only its own top k before
the rows meet, so the shuffle is k rows for each partition and query.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: Where every row is a query: queries that a task holds at once, and rows of both sides of one product, which takes 8 * TILE * PIECE bytes.
BLOCK, TILE, PIECE = 16_384, 1_024, 4_096


def normalized(v: Column) -> Column:
    """Unit vector in float64, stored as float32; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # the norm is bound as an element, since an expression inside the inner function would be computed for each element
    return F.transform(F.array(F.when(norm == 0, 1.0).otherwise(norm)), lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast("float")))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def top_k(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, types: list[str] | None = None, tie: str = "uid") -> DataFrame:
    """(query_id, <tie>, score, rank) of the k nearest by cosine; ties by ``tie``; vectors of another dimension are skipped.

    ``vectors`` has dim, vector (unit), type and the tie column. An empty list of types is no filter; k <= 0 gives nothing.
    """
    if types:
        vectors = vectors.where(F.col("type").isin([str(t) for t in types]))
    kind = vectors.schema[tie].dataType.simpleString()
    schema = f"query_id long, `{tie}` {kind}, score double"
    by_dim: dict[int, list[tuple[int, list[float]]]] = {}
    for q, v in queries:
        by_dim.setdefault(len(v), []).append((q, v))
    spark = vectors.sparkSession
    out = spark.createDataFrame([], schema)
    for dim, group in sorted(by_dim.items()) if k > 0 else []:
        ids = np.array([q for q, _ in group])
        m = np.array([v for _, v in group], np.float64)

        def run(batches, dim=dim, ids=ids, m=m):
            best = None
            for batch in batches:
                if not len(batch):
                    continue
                # the last bits of a sum depend on a row's place in its batch; 9 decimals don't, so equal vectors tie
                s = np.round(_matrix(batch.column(1), dim) @ m.T, 9)
                rows = pd.DataFrame({"query_id": np.repeat(ids, len(batch)), tie: np.tile(np.asarray(batch.column(0)), len(ids)), "score": s.T.ravel()})
                best = rows if best is None else pd.concat([best, rows])
                best = best.sort_values(["query_id", "score", tie], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield pa.RecordBatch.from_pandas(best, preserve_index=False)

        out = out.unionAll(vectors.where(F.col("dim") == dim).select(tie, "vector").mapInArrow(run, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie))
    return out.withColumn("rank", rank).where(F.col("rank") <= max(k, 0))


def top_k_all(vectors: DataFrame, k: int, types: list[str] | None = None, tie: str = "node_id", block: int = BLOCK) -> DataFrame:
    """(query_id, <tie>, score, rank) as ``top_k``, with every row as a query; ``types`` limits what is found, not what is asked.

    Nothing meets on the driver. What can be found is stored once, in the order
    of ``tie``; a task takes up to ``block`` queries at once and reads all of it
    in pieces, keeping k rows for each query. So rows move once, however many
    there are, and only products grow with their square. Scores count to 9
    decimals in the order, so equal vectors tie wherever they lie.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[tie].dataType.simpleString()
    schema = f"query_id {kind}, `{tie}` {kind}, score double, rank int"
    if k <= 0:
        return spark.createDataFrame([], schema)
    rows = vectors.where("vector is not null and dim > 0")
    held = rows.where(F.col("type").isin([str(t) for t in types])) if types else rows
    at = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    held.select(F.col(tie).alias("id"), "vector", "dim").repartitionByRange("id").sortWithinPartitions("dim", "id").write.partitionBy("dim").parquet(at)
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-rows.count() // TILE)))

    def nearest(asked: pa.Table, dim: int):
        m, start = _matrix(asked["vector"].combine_chunks(), dim), 0
        least = np.full(len(m), -np.inf)
        query, score, place, ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), None
        for batch in _stored(at, dim):
            v_ids, held = batch.column(0), _matrix(batch.column(1), dim)
            found = []
            for lo in range(0, len(m), TILE):
                s = m[lo : lo + TILE] @ held.T
                low = least[lo : lo + TILE, None]
                if k < len(held) and np.isneginf(low).any():
                    low = np.where(np.isneginf(low), np.partition(s, -k, axis=1)[:, -k, None] - 1e-9, low)
                q, v = np.nonzero(s >= low)
                found.append((q + lo, s[q, v], v))
            q, s, v = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(q):
                query, score, place = np.concatenate([query, q]), np.concatenate([score, s]), np.concatenate([place, v + start])
                new = v_ids.take(pa.array(v))
                ids = new if ids is None else pa.concat_arrays([ids, new])
                order = np.lexsort((place, -np.round(score, 9), query))
                rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                order, rank = order[rank < k], rank[rank < k]
                query, score, place, ids = query[order], score[order], place[order], ids.take(pa.array(order))
                # rows come in the order of ties, so what comes later must be better by more than rounding
                least[query[rank == k - 1]] = np.round(score[rank == k - 1], 9) + 4e-10
            start += len(held)
        if ids is not None:
            yield from pa.table({"query_id": asked["id"].take(pa.array(query)), tie: ids, "score": score, "rank": (np.arange(len(query)) - np.searchsorted(query, query) + 1).astype(np.int32)}).to_batches()

    def run(batches):
        wait: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for dim in pc.unique(batch["dim"]).to_pylist():
                part = batch.filter(pc.equal(batch["dim"], dim))
                wait.setdefault(dim, []).append(part)
                if sum(map(len, wait[dim])) >= block:
                    yield from nearest(pa.Table.from_batches(wait.pop(dim)), dim)
        for dim, parts in wait.items():
            yield from nearest(pa.Table.from_batches(parts), dim)

    return rows.select("dim", F.col(tie).alias("id"), "vector").repartition(tasks, "id").mapInArrow(run, schema)


def _stored(at: str, dim: int):
    """The rows (id, vector) of a dimension of a table of vectors in pieces, file after file."""
    fs, path = pa_fs.FileSystem.from_uri(f"{at}/dim={dim}")
    if fs.get_file_info(path).type == pa_fs.FileType.NotFound:
        return
    for name in sorted(x.path for x in fs.get_file_info(pa_fs.FileSelector(path)) if x.path.endswith(".parquet")):
        with fs.open_input_file(name) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=PIECE, columns=["id", "vector"])


def prevailing_dim(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1)


def cosines(vectors: DataFrame, ids: DataFrame, query: list[float]) -> DataFrame:
    """(id, cosine) in [0, 1]; 0 for ids without a vector of this dimension."""
    q = F.array(*(F.lit(float(x)).cast("float") for x in query))
    have = vectors.where(F.col("dim") == len(query)).select(F.col("node_id").alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col("vector"), q))).alias("cosine"))
    return ids.select("id").join(have, "id", "left").select("id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
