"""Revisit search against brute force; its work at twice the density."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import revisits


def brute(rows, radius, apart):
    out = {}
    for k, i, u, v, t in rows:
        best = min(((u - x) ** 2 + (v - y) ** 2, j) for q, j, x, y, s in rows if q == k and abs(s - t) >= apart) if any(q == k and abs(s - t) >= apart for q, _, _, _, s in rows) else None
        if best and best[0] < radius * radius:
            out[k, i] = (best[1], best[0])
    return out


@pytest.mark.parametrize("leaf,chunk,guests", [(512, 65_536, 32_768), (7, 50, 5)])
def test_nearest_at_another_time(spark, monkeypatch, leaf, chunk, guests):
    for name, value in (("LEAF", leaf), ("CHUNK", chunk), ("VISITS", guests)):
        monkeypatch.setattr(revisits, name, value)
    rng = np.random.default_rng(leaf)
    rows = [(["a", "b", None][i % 3], i, float(np.round(rng.normal() * 2, 1)), float(np.round(rng.normal(), 1)), float(rng.integers(0, 60))) for i in range(700)]
    rows += [("a", 1000 + i, 0.0, 0.0, float(i)) for i in range(60)] + [("c", 1, 5.0, 5.0, 0.0), ("c", 2, 5.3, 5.0, 30.0), ("c", 3, 5.0, 5.0, 10.0)]
    d = spark.createDataFrame([*rows, ("a", 5000, None, 0.0, 0.0)], "k string, id long, u double, v double, t double").repartition(5)
    got = {(r.k, r.id): (r.near_id, r.d2) for r in revisits.revisit_distance(d, "id", ("u", "v"), "t", 0.35, 20.0, ["k"]).collect()}
    want = brute([r for r in rows if r[0] is not None], 0.35, 20.0) | {k: v for k, v in brute([("", *r[1:]) for r in rows if r[0] is None], 0.35, 20.0).items()}
    assert {(k or "", i): (j, round(x, 9)) for (k, i), (j, x) in got.items() if k is not None} == {(k, i): (j, round(x, 9)) for (k, i), (j, x) in want.items() if k}
    assert revisits.revisit_distance(d.limit(0), "id", ("u", "v"), "t", 0.35, 20.0, ["k"]).count() == 0


def test_work_is_linear_in_the_rows(spark):
    """The same floor walked twice, at growing density: visits a row stay the same."""
    per_row = []
    for n in (20_000, 40_000, 80_000):
        d = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("_id"), (F.rand(1) * 3).alias("_u"), (F.rand(2) * 3).alias("_v"), (F.col("id") % 2 * 100 + F.rand(3) * 10).alias("_t"))
        cut = revisits.leaves(d, ["k"], 0.15, 20.0)
        assert cut.groupBy("_leaf").count().agg(F.max("count")).first()[0] <= revisits.LEAF
        per_row.append(revisits.visits(cut, ["k"], 0.15, 20.0).count() / n)
    assert per_row[-1] < 1.2 * per_row[0] and per_row[-1] < 1.5
