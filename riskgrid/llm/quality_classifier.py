"""Quality classifier: naive Bayes support vectors on character n-grams and repeated-word n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm import nbsvm
from riskgrid.llm.common import crc_of_id

FEATURES = nbsvm.Features(orders=(1, 2, 3), bits=18, runs=8)
#: Most labelled rows that a fit takes; at least as many as fix a linear model of this size.
TRAINING_ROWS = 4000
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> nbsvm.Model:
    """Fit on the labelled rows of ``labels`` (doc_id, quality); see nbsvm for the cases."""
    return nbsvm.fit(FEATURES, *nbsvm.training_rows(docs, labels, "quality", FEATURES, limit))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, limit: int = TRAINING_ROWS) -> DataFrame:
    """Score every row; rows whose crc32(id) mod ``folds`` is ``held_fold`` never train.

    Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier) and
    predicted. One row out for each row in, repeated ids included; the order
    is not defined. A null id is not held out and cannot train.
    """
    held = F.coalesce(crc_of_id() % folds == held_fold, F.lit(False))
    model = train(docs, labels.where(~held), limit)
    return nbsvm.scored(docs, model, held, THRESHOLD)
