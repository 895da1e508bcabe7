"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Shallow boosted trees over document statistics give paths; each path is a
conjunction of bounds on statistics. A lasso logistic regression over the
conjunctions keeps few of them, and these become one Column expression, so
that scoring stays in Catalyst. One ensemble tells good from poor documents,
a second tells toxic from other documents; a document is kept if it is good
and not toxic.

Defined cases: a null or empty text has statistics 0 and is scored like any
text; repeated rows are scored one by one; an empty table gives an empty
result; without usable labels every document is kept (probability 0.5 counts
as good and as not toxic).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import docstats, trees
from .common import fresh, trim
from .labelled import SAMPLE_ROWS, training

GOOD_AT = 0.5
TOXIC_AT = 0.5


@dataclass
class Rules:
    """Weighted conjunctions over ``docstats.NAMES``."""

    intercept: float
    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return trees.sigmoid(self.intercept + trees.holds(self.rules, x) @ self.weights)

    def column(self, stat) -> Column:
        """Probability as a Column; ``stat(name)`` gives the Column of a statistic."""
        terms = []
        for rule, weight in zip(self.rules, self.weights, strict=True):
            conds = [stat(docstats.NAMES[k]) <= thr if le else stat(docstats.NAMES[k]) > thr for k, le, thr in rule]
            terms.append(F.when(reduce(lambda a, b: a & b, conds), float(weight)).otherwise(0.0))
        # a chain of additions becomes one method of over 64 KB, on which the driver's compiler spends its heap in vain
        z = F.aggregate(F.array(*terms), F.lit(float(self.intercept)), lambda a, b: a + b) if terms else F.lit(float(self.intercept))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> Rules:
    """Tree paths, then lasso; rules with weight 0 go."""
    forest = trees.fit(x, y, trees=30, depth=3, rate=0.3, row_share=0.7)
    rules = trees.paths(forest)
    intercept, weights = trees.lasso_logistic(trees.holds(rules, x), y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-3)
    return Rules(intercept, [rules[k] for k in kept], weights[kept])


@dataclass
class Classifier:
    good: Rules
    toxic: Rules
    lexicon: np.ndarray

    def columns(self, stat) -> tuple[Column, Column, Column]:
        """(good, toxic, keep)."""
        good, toxic = self.good.column(stat), self.toxic.column(stat)
        return good, toxic, (good >= GOOD_AT) & (toxic <= TOXIC_AT)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled documents."""
    x, quality, toxic, lexicon = training(docs, labels, rows)
    if not len(x):
        even = Rules(0.0, [], np.zeros(0))
        return Classifier(even, even, lexicon)
    model = Classifier(fit_rules(x, quality), fit_rules(x, toxic), lexicon)
    trim()
    return model


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, good, toxic, keep): a row for each row of ``docs``."""
    good, toxic, keep = model.columns(F.col)
    stats = docstats.with_statistics(docs, model.lexicon)
    return stats.select("doc_id", F.round(good, 6).alias("good"), F.round(toxic, 6).alias("toxic"), keep.alias("keep"))


def accepted(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    name = fresh(docs, "stats")
    _, _, keep = model.columns(lambda c: F.col(f"`{name}`.`{c}`"))
    return docstats.append_statistics(docs, model.lexicon, name).where(keep).drop(name)
