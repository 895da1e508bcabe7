"""Quality rules: gradient-boosted trees over document statistics.

The trees are flat numpy node arrays, walked for all rows of an Arrow batch
at once. The score for a good document may only fall as repetition or odd
marks grow, the score for a toxic one only rise with flagged words.

Defined cases: a null or empty text has statistics 0 and is scored like any
text; repeated rows are scored one by one; an empty table gives an empty
result; without usable labels every score is 0.5 and every document is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import docstats, trees
from . import words as W
from .common import arrow_map, id_text, text_of
from .labelled import SAMPLE_ROWS, training

_AT = {c: k for k, c in enumerate(docstats.NAMES)}
GOOD_SIGNS = {_AT[c]: -1 for c in ("odd_marks_per_word", "echo_share", "repeat_line_share", "upper_share")}
TOXIC_SIGNS = {_AT[c]: 1 for c in ("flagged_words", "flagged_share")}
GOOD_AT = 0.5
TOXIC_AT = 0.5


@dataclass
class Model:
    good: trees.Forest
    toxic: trees.Forest
    lexicon: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit both forests on at most ``rows`` labelled documents."""
    x, quality, toxic, lexicon = training(docs, labels, rows)
    return Model(trees.fit(x, quality, monotone=GOOD_SIGNS), trees.fit(x, toxic, monotone=TOXIC_SIGNS), lexicon)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, good, toxic, keep): a row for each row of ``docs``."""

    def run(batch):
        ids = batch.column(0)
        for at, part in W.passes(text_of(batch)):
            x = docstats.statistics(part, model.lexicon)
            good, toxic = model.good.probability(x), model.toxic.probability(x)
            keep = (good >= GOOD_AT) & (toxic <= TOXIC_AT)
            yield pa.table([ids.slice(at, len(part)), np.round(good, 6), np.round(toxic, 6), keep], ["doc_id", "good", "toxic", "keep"])

    return arrow_map(id_text(docs), run, "doc_id long, good double, toxic double, keep boolean")
