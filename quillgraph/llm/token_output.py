"""Token ids as flat unsigned integer files with 64-bit document offsets.

Each partition of the documents becomes a shard: ``shard-N-U.bin`` holds the ids
of its documents one after another, each ended by the end id, in the smallest
of uint8/16/32 that fits the vocabulary, little-endian. ``shard-N-U.idx`` holds
int64 offsets of its documents, one more than documents, counted from the
start of the whole corpus: the shard's base, a prefix sum over the shards'
token counts, plus the place in the shard. ``manifest.json`` lists shards and
bases, and is written last. Files are memory-mapped by ``Corpus``.

U is a name of the attempt of a task. The index of documents has the U of the
attempt whose rows Spark took, so a task that is run again, or twice at once,
maybe over rows in another order, leaves an index that fits its file; files of
other attempts aren't in the manifest. The vocabulary is sent to the executors.

Defined cases: a null or empty text is a document of only the end id; rows are
documents one by one, also repeated ones and those without an id; an empty
table gives a manifest without shards and an empty result; texts are encoded
whole, whatever their length; other columns are never read, so their names
can't clash.
"""

from __future__ import annotations

import base64
import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import id_text, lean, new_path, stored, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
#: Shards up to which their bases are broadcast; of more, both sides are sorted and merged.
FEW_SHARDS = 100_000

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str, pattern: str = PATTERN):
    """The byte-level BPE of a rank file, built once in each worker."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def encode(text: str, vocabulary: str, pattern: str = PATTERN) -> list[int]:
    """Ids of a whole text. Where the library's pattern engine gives up, pieces are found by another engine."""
    enc = encoder(vocabulary, pattern)
    try:
        return enc.encode_ordinary(text)
    except BaseException as e:  # noqa: BLE001 - the library's panics are BaseExceptions of its own
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
        import regex

        return [i for m in regex.finditer(pattern, text) for i in enc._encode_single_piece(m.group())]


def id_type(end_id: int, vocabulary_size: int) -> np.dtype:
    top = max(end_id, vocabulary_size - 1)
    return np.dtype("u1" if top < 256 else "<u2" if top < 65536 else "<u4")


def _put(path: str, data: bytes | memoryview) -> None:
    """Write beside the place, then rename over it."""
    files, at = fs.FileSystem.from_uri(path)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, at)


def _shard(n: int, attempt: str) -> str:
    return f"shard-{n:06d}-{attempt}"


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, pattern: str = PATTERN) -> DataFrame:
    """Write the files into ``folder``; (doc_id, shard, attempt, position, token_start, tokens), a row for each document.

    ``token_start`` is the document's offset in the corpus, ``tokens`` counts its
    end id, ``position`` its place in the shard.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        kind = id_type(end_id, sum(1 for _ in f))
    spark.sparkContext.addFile(vocabulary)
    ranks = os.path.basename(vocabulary)

    def run(batches):
        shard, attempt, vocabulary = TaskContext.get().partitionId(), uuid.uuid4().hex, SparkFiles.get(ranks)
        files, at = fs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        place = total = 0
        out = None
        for batch in batches:
            for first, texts in W.passes(text_of(batch)):
                ids = [np.array([*encode(t, vocabulary, pattern), end_id], kind) for t in texts.to_pylist()]
                if out is None:
                    out = files.open_output_stream(f"{at}/{_shard(shard, attempt)}.bin")
                out.write(np.concatenate(ids).tobytes())
                n = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ids)), pa.array(np.full(len(ids), shard)), pa.array([attempt] * len(ids)), pa.array(np.arange(place, place + len(ids))), pa.array(total + np.cumsum(n) - n), pa.array(n)],
                    ["doc_id", "shard", "attempt", "position", "token_start", "tokens"],
                )
                place += len(ids)
                total += int(n.sum())
        if out is not None:
            out.close()

    local = stored(id_text(docs).mapInArrow(lean(run), "doc_id long, shard long, attempt string, position long, token_start long, tokens long"), "token-index")
    # one row for each shard, as the manifest lists them: prefix sums of these are the bases
    sums = local.groupBy("shard", "attempt").agg(F.sum("tokens").alias("n"), F.count("*").alias("documents"))
    bases = sums.orderBy("shard").toPandas()
    bases["base"] = bases["n"].cumsum() - bases["n"]
    known = spark.createDataFrame(bases[["shard", "base"]], "shard long, base long") if len(bases) else sums.select("shard", F.lit(0).cast("long").alias("base"))
    known = F.broadcast(known) if len(bases) <= FEW_SHARDS else known.hint("merge")
    out = local.join(known, "shard").select("doc_id", "shard", "attempt", "position", (F.col("token_start") + F.col("base")).alias("token_start"), "tokens")

    def offsets(batches):
        # batches of one partition, sorted by shard and position
        held: list[np.ndarray] = []
        attempts: dict[int, str] = {}
        for batch in batches:
            attempts.update(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True))
            cols = np.stack([np.asarray(c) for c in batch.columns[:4]])
            for s in np.unique(cols[0]):
                if held and held[0][0, 0] != s:
                    yield put(held, attempts)
                    held = []
                held.append(cols[:, cols[0] == s])
        if held:
            yield put(held, attempts)

    def put(held: list[np.ndarray], attempts: dict[int, str]) -> pa.RecordBatch:
        cols = np.concatenate(held, axis=1)
        start, n = cols[2], cols[3]
        _put(f"{folder}/{_shard(int(cols[0, 0]), attempts[int(cols[0, 0])])}.idx", np.append(start, start[-1:] + n[-1:]).astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(cols[0, :1]), pa.array([len(n)])], ["shard", "documents"])

    ordered = out.select("shard", "position", "token_start", "tokens", "attempt").repartition("shard").sortWithinPartitions("shard", "position")
    written = {int(r.shard): int(r.documents) for r in ordered.mapInArrow(lean(offsets), "shard long, documents long").collect()}
    if written != dict(zip(bases["shard"].astype(int), bases["documents"].astype(int), strict=True)):
        raise RuntimeError("shards and offsets don't agree")
    shards = [{"name": _shard(int(r.shard), r.attempt), "base": int(r.base), "tokens": int(r.n), "documents": int(r.documents)} for r in bases.itertuples()]
    manifest = {"dtype": kind.str, "end_id": end_id, "shards": shards}
    files, at = fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    _put(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return out


def output(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``write`` into a new folder of the shared folder; the result names the file of each document."""
    folder = new_path(docs.sparkSession, "token-ids")
    file = F.format_string("%s/shard-%06d-%s.bin", F.lit(folder), F.col("shard"), F.col("attempt"))
    return write(docs, folder, vocabulary).withColumn("file", file).drop("attempt")


class Corpus:
    """Memory-mapped reader of a folder on a local or mounted disk."""

    def __init__(self, folder: str):
        self.at = folder.removeprefix("file://")
        with open(f"{self.at}/manifest.json") as f:
            self.manifest = json.load(f)
        kind = np.dtype(self.manifest["dtype"])
        self.shards = [(s["base"], np.memmap(f"{self.at}/{s['name']}.bin", kind, "r"), np.memmap(f"{self.at}/{s['name']}.idx", "<i8", "r")) for s in self.manifest["shards"]]
        self.first = np.cumsum([0] + [s["documents"] for s in self.manifest["shards"]])

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, n: int) -> np.ndarray:
        """Ids of the n-th document, with its end id."""
        if not 0 <= n < len(self):
            raise IndexError(n)
        s = int(np.searchsorted(self.first, n, side="right")) - 1
        base, ids, offsets = self.shards[s]
        k = n - int(self.first[s])
        return ids[offsets[k] - base : offsets[k + 1] - base]
