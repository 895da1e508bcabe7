"""Statistics of whole documents, vectorised over Arrow batches.

Every statistic is a double; a text without words (null, empty, only marks)
has 0 for all that divide by words. ``flagged_*`` count words of a learned
list (``lexicon``) of 64-bit word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, id_text, text_of

NAMES = (
    "log_words", "mean_word_bytes", "marks_per_word", "odd_marks_per_word", "upper_share", "digit_share",
    "distinct_share", "echo_share", "top_word_share", "repeat_gram_share", "line_words", "repeat_line_share",
    "long_word_share", "one_byte_word_share", "end_mark_per_word", "flagged_words", "flagged_share",
)

_UPPER, _DIGIT, _MARK, _ODD, _END, _LETTER = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_ODD[[ord(c) for c in "#$%&*+<=>@[]\\^_`{|}~"]] = True
_END[[ord(c) for c in ".!?"]] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each [offsets[i], offsets[i + 1])."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _runs(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, largest count, all values) of ``h`` in each document."""
    key = np.sort((doc.astype(np.uint64) << W.U64(44)) | (h >> W.U64(20)))
    if not len(key):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(at, len(key)))
    owner = (key[at] >> W.U64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, size)
    return np.bincount(owner, minlength=n).astype(float), top, np.bincount(doc, minlength=n).astype(float)


def statistics(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each text of one pass."""
    texts = W.column(texts)
    w = W.split(texts)
    raw, off = W.raw_bytes(texts)
    n, doc, h = w.n_docs, w.doc_of_word, w.hashes
    length = w.ends - w.starts
    words = np.diff(w.doc_words).astype(float)
    per = np.maximum(words, 1)
    letters = np.maximum(_per_doc(_LETTER[raw], off), 1)
    distinct, top, _ = _runs(doc, h, n)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    gram, ok = w.grams(4)
    grams, _, all_grams = _runs(doc[ok], gram[ok], n)
    # lines: cut at newlines and at texts; a line's hash is that of its bytes
    newline = np.flatnonzero(raw == 10)
    cut = np.unique(np.concatenate((off, newline + 1)))
    line_at, line_to = cut[:-1], cut[1:]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw.astype(np.uint64) * W.powers(W._BASE, len(raw)), out=sums[1:])
    to = np.where(raw[line_to - 1] == 10, line_to - 1, line_to) if len(line_to) else line_to
    full = to > line_at
    line_hash = W.mix((sums[to] - sums[line_at]) * W.powers(W._BASE_INV, len(raw) + 1)[line_at])[full]
    line_doc = np.searchsorted(off, line_at, side="right")[full] - 1
    lines, _, all_lines = _runs(line_doc, line_hash, n)
    flagged = np.bincount(doc[np.isin(h, lexicon)], minlength=n).astype(float) if len(lexicon) else np.zeros(n)
    share = lambda flags: _per_doc(flags, w.doc_words) / per
    marks = _per_doc(_MARK[raw], off)
    has = words > 0
    out = [
        np.log1p(words), _per_doc(length, w.doc_words) / per, marks / per, _per_doc(_ODD[raw], off) / per,
        _per_doc(_UPPER[raw], off) / letters, _per_doc(_DIGIT[raw], off) / np.maximum(np.diff(off), 1),
        np.where(has, distinct / per, 0), share(echo), top / per,
        np.where(all_grams > 0, 1 - grams / np.maximum(all_grams, 1), 0), words / np.maximum(all_lines, 1),
        np.where(all_lines > 0, 1 - lines / np.maximum(all_lines, 1), 0), share(length >= 16), share(length == 1),
        _per_doc(_END[raw], off) / per, flagged, flagged / per,
    ]
    return np.stack(out, axis=1)


def with_statistics(docs: DataFrame, lexicon: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one double for each of NAMES), a row for each row of ``docs``."""

    def run(batch):
        ids = batch.column(0)
        for at, part in W.passes(text_of(batch)):
            x = statistics(part, lexicon)
            yield pa.table([ids.slice(at, len(part)), *(pa.array(c) for c in x.T)], ["doc_id", *NAMES])

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"{c} double" for c in NAMES))


def append_statistics(docs: DataFrame, lexicon: np.ndarray, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name`` of its statistics; all other columns pass through."""
    text_at = docs.columns.index(text_col)

    def run(batch):
        texts = text_of(batch, batch.schema.names[text_at])
        for at, part in W.passes(texts):
            x = statistics(part, lexicon)
            stats = pa.StructArray.from_arrays([pa.array(c) for c in x.T], list(NAMES))
            rows = batch.slice(at, len(part))
            yield pa.RecordBatch.from_arrays([*rows.columns, stats], [*batch.schema.names, name])

    schema = docs.limit(0).withColumn(name, F.struct(*(F.lit(0.0).cast("double").alias(c) for c in NAMES))).schema
    for field in schema.fields:
        field.nullable = True
    return arrow_map(docs, run, schema)


def word_hashes(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(distinct word hash, *more) of each document."""

    def run(batch):
        for at, part in W.passes(text_of(batch)):
            w = W.split(part)
            doc = w.doc_of_word
            order = np.lexsort((w.hashes, doc))
            d, h = doc[order], w.hashes[order]
            first = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.zeros(0, bool)
            rows = pa.array(d[first] + at)
            yield pa.table([pa.array(h[first].view(np.int64)), *(batch.column(2 + i).take(rows) for i in range(len(more)))], ["word", *more])

    df = id_text(docs, id_col, text_col, *more)
    return arrow_map(df, run, "word long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[2:]))
