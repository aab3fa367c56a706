"""Quantiles of large groups equal Spark's percentile, whatever the values are like."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import selection

SHARES = [0.0, 0.16, 0.5, 0.97, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    groups = {"normal": rng.normal(size=9000), "ties": rng.integers(0, 3, 9000).astype(float), "one": np.full(5000, 7.5), "wide": rng.choice([-1.0, 1.0], 4000) * 10.0 ** rng.uniform(-300, 308, 4000), "small": rng.normal(size=9), "skewed": np.concatenate((np.full(8000, 1e-9), [1e9])), None: rng.exponential(size=3000)}
    rows = [(k, 1 if k != "small" else None, float(x)) for k, xs in groups.items() for x in xs] + [("normal", 1, None), ("empty", 1, None), ("normal", 1, float("nan"))]
    return spark.createDataFrame(rows, "k string, j int, x double").repartition(5).cache()


@pytest.mark.parametrize("bins", [1024, 16])
def test_as_percentile(values, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    want = {r[0:2]: r[2:] for r in values.filter("NOT isnan(x)").groupBy("k", "j").agg(*[F.percentile("x", s) for s in SHARES]).filter("k IS NULL OR k <> 'empty'").collect()}
    got = {r[0:2]: r[2:] for r in selection.quantiles(values, "x", SHARES, ["k", "j"]).collect()}
    assert got == want


def test_without_keys_and_joined(values, monkeypatch):
    monkeypatch.setattr(selection, "BROADCAST_ROWS", 0)
    d = values.filter("NOT isnan(x)")
    assert tuple(selection.quantiles(values, F.col("x") * 2, [0.3, 0.5], names=["a", "b"]).first()) == tuple(d.agg(F.percentile(F.col("x") * 2, 0.3), F.percentile(F.col("x") * 2, 0.5)).first())
    assert selection.quantiles(values.limit(0), "x", [0.5], ["k"]).count() == 0


def test_no_buffer_beyond_the_bins(spark, values):
    """What rounds collect: at most BINS rows a group meet in one aggregate of values."""
    v = values.filter("x IS NOT NULL AND NOT isnan(x) AND k = 'normal'").select(F.lit(0).alias("_k0"), F.col("x").alias("_x"))
    stats = v.groupBy("_k0").agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    seen = []
    plain = selection._joined

    def watched(values, intervals, names):
        d = plain(values, intervals, names)
        seen.append((intervals.count(), d.count()))
        return d

    selection._joined = watched
    try:
        got = selection.order_statistics(v, stats.withColumn("_rank", F.lit(4500).cast("long")), ["_k0"]).collect()
    finally:
        selection._joined = plain
    xs = sorted(r.x for r in values.filter("x IS NOT NULL AND NOT isnan(x) AND k = 'normal'").collect())
    assert [r._value for r in got] == [xs[4500]]
    assert seen[0] == (0, 0) and seen[1][1] == 9000 and seen[2][1] <= selection.BINS
