"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Case is folded for all letters, n-grams are of code points, and each ratio is
drawn towards 0 by ``ERRORS`` standard errors (see nbsvm), chosen by
cross-validation within the training folds.

Defined cases: a null text counts as empty, and an empty text has the score
that no feature at all gives; very long texts are scored whole; repeated rows
are scored each time; a null id is not held out and never trains; without
labels, or with one class only, all rows have one score; extra columns stay
(``drop_toxic``) or are not read (``classify``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm import nbsvm
from riskgrid.llm.common import crc_of_id

FEATURES = nbsvm.Features(orders=(4, 5, 6), bits=20, lower=True)
ERRORS = 2.0
TRAINING_ROWS = 4000
THRESHOLD = 0.3
#: Fold of crc32(id) that never trains.
FOLDS, HELD_FOLD = 4, 2


def held_out():
    return F.coalesce(crc_of_id() % FOLDS == HELD_FOLD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> nbsvm.Model:
    """Fit on the rows of ``labels`` (doc_id, toxic) outside the held-out fold."""
    return nbsvm.fit(FEATURES, *nbsvm.training_rows(docs, labels.where(~held_out()), "toxic", FEATURES, limit), ERRORS)


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; cases as in nbsvm."""
    return nbsvm.scored(docs, train(docs, labels, limit), held_out(), THRESHOLD)


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """The rows whose score stays below the threshold, columns as they are."""
    model = train(docs, labels, limit)
    return docs.where(nbsvm.score_column(docs.sparkSession, model) < THRESHOLD)
