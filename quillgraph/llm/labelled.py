"""Training rows for the document classifiers, from a bounded sample of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats
from .common import id_text, stored, trim

#: Bound of the labelled sample that the classifiers fit: the labelled documents with the smallest hashed ids.
SAMPLE_ROWS = 20_000
#: Bound of the learned word list.
LEXICON_WORDS = 500


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, quality, toxic) of at most ``rows`` labelled documents, written to the shared folder.

    Labels without an id or with a null label are not used; of several labels
    for an id the smallest of each counts, of several documents with an id each
    counts.
    """
    lab = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int"))
        .dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    lab = stored(lab, "labels")
    # the bound keeps the broadcast side small: rows x 16 bytes
    out = id_text(docs).join(F.broadcast(lab), "doc_id")
    return stored(out, "labelled")


def toxic_lexicon(labelled: DataFrame, least: int = 5, most: int = LEXICON_WORDS) -> np.ndarray:
    """Hashes of the words that mark toxic documents.

    Words in at least ``least`` toxic documents, at most ``most`` of them, by
    the lower end of the Wilson interval of their rate of toxic documents,
    which must exceed both a half and the rate over all documents.
    """
    z = 2.0
    words = docstats.word_hashes(labelled, "doc_id", "text", "toxic").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).where(F.col("k") >= least)
    share = labelled.agg(F.avg("toxic")).first()[0] or 0.0
    rate, n = F.col("k") / F.col("n"), F.col("n")
    lower = (rate + z * z / (2 * n) - z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    top = words.withColumn("low", lower).where(F.col("low") > max(0.5, share)).orderBy(F.desc("low"), "word").limit(most).select("word").collect()
    return np.sort(np.array([r[0] for r in top], np.int64)).view(np.uint64)


def training(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, quality, toxic, lexicon). At most ``rows`` rows of doubles come to the driver."""
    lab = sample(docs, labels, rows)
    lexicon = toxic_lexicon(lab)
    stats = docstats.append_statistics(lab.select("doc_id", "text", "quality", "toxic"), lexicon, "stats")
    got = stats.select("doc_id", "quality", "toxic", "stats.*").orderBy("doc_id", *docstats.NAMES).toPandas()
    x = got[list(docstats.NAMES)].to_numpy(float).reshape(-1, len(docstats.NAMES))
    y, z = got["quality"].to_numpy(float), got["toxic"].to_numpy(float)
    del got
    trim()
    return x, y, z, np.unique(lexicon)
