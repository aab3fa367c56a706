"""Toxicity: zstandard dictionaries of toxic and ordinary text; the windows' compressed lengths against calibrated thresholds.

See compression.py for the method and for nulls, empty texts and missing classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import compression
from .common import columns, spare

WINDOWS = (64, 192)
THRESHOLD = 0.5


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held: int = 0, per_class: int = compression.PER_CLASS, **columns) -> compression.Model:
    return compression.train(compression.sample(docs, labels, "toxic", modulus, held, per_class=per_class, **columns), kind="contrast", sizes=WINDOWS, lower=True)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that aren't toxic, all columns as they are; all rows where the labels don't show both classes."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    if not model.calibrated:
        return docs
    (score,) = spare(docs, "score")
    return docs.withColumn(score, compression.score_of(model, text_col)).filter(F.col(score) < THRESHOLD).select(*columns(docs))
