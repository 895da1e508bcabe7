"""From documents to token files: the stages in order, each written as Parquet and read again.

All but the last return the columns of the documents, whatever they are called.
Defined cases, stage by stage:

- Quality classifier: each row is judged by its text; a null or empty text is
  judged as one without words. Rows without an id, repeated rows and several
  texts of an id are judged one by one.
- SimHash near-dedup: of each group of near copies the smallest id stays, with
  one row (of several, that with the smallest hash of all columns). Texts
  without words have no copies, and rows without an id take no part: they stay.
- Benchmark decontamination: all rows of an id go if one of them holds an item.
  Rows without an id stay; null and empty texts hold nothing.
- Mixing sources: rows without an id can't be drawn, so they end here. A null
  source is a source of its own.
- Token output: a row for each row left; a null or empty text is a document of
  only the end id.

Long texts are taken whole by every stage. An empty table gives an empty
result, with a manifest without shards. Ties are broken by the smallest id, or
by a hash of the row, never by the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, mixing, quality_classifier, simhash, token_output
from quillgraph.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample in which sources have their target weights."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; the index of documents in them."""
    return token_output.output(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]

#: SQL can't express the trained classifier or the draw; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
