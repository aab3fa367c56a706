"""Quality classifier: zstandard dictionaries of good and bad texts; the normalised difference of compressed sizes, calibrated.

See compression.py for the method and for nulls, empty texts and missing classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import compression

WINDOW = 512


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held: int = 2, per_class: int = compression.PER_CLASS, **columns) -> compression.Model:
    return compression.train(compression.sample(docs, labels, "quality", modulus, held, per_class=per_class, **columns), kind="plain", sizes=(WINDOW,), lower=False, base_bytes=65_536)
