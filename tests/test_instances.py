"""Greedy instances against the plain fold, and that equal sightings count together."""

from __future__ import annotations

import numpy as np
import pandas as pd

from plumbline.operators import graph


def plain(rows, radius=0.6, views=2):
    found: list[list] = []
    for _, u, v in sorted(rows):
        for members in found:
            m = np.median(np.array(members), axis=0)
            if np.hypot(m[0] - u, m[1] - v) < radius:
                members.append((u, v))
                break
        else:
            found.append([(u, v)])
    return [(i, *map(float, np.median(np.array(m), axis=0)), len(m)) for i, m in enumerate(found) if len(m) >= views]


def test_instances_like_the_plain_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(float(o), float(u), float(v)) for o, u, v in zip(rng.integers(0, 3, 400), rng.normal(0, 1.2, 400).round(1), rng.normal(0, 1.2, 400).round(1), strict=True)]
    d = spark.createDataFrame(pd.DataFrame([(1, *r) for r in rows], columns=["k", "o", "u", "v"]))
    got = graph.greedy_instances(d, ["k"], ("u", "v"), ["o", "u", "v"]).orderBy("instance").collect()
    assert [tuple(r)[1:] for r in got] == plain(rows)


def test_many_sightings_of_few_places(spark):
    """200,000 sightings of one class: the plain fold takes a median of all members for each."""
    d = spark.range(200_000).selectExpr("0 AS k", "CAST(id % 3 AS double) AS o", "CAST(id % 5 * 2 AS double) AS u", "CAST(id % 7 * 0.01 AS double) AS v")
    seen = []
    apply = type(d.groupBy("k")).applyInPandas

    def watch(self, f, schema):
        seen.append(self._df.count())
        return apply(self, f, schema)

    type(d.groupBy("k")).applyInPandas = watch
    try:
        got = graph.greedy_instances(d, ["k"], ("u", "v"), ["o", "u", "v"]).collect()
    finally:
        type(d.groupBy("k")).applyInPandas = apply
    assert sorted((r["u"], round(r["v"], 2), r["views"]) for r in got) == [(2.0 * i, 0.03, 40_000) for i in range(5)]
    assert seen == [105]


def test_few_calls_for_many_keys(spark, monkeypatch):
    """9000 keys of two sightings each: keys share calls, and each keeps its own instances."""
    d = spark.range(18_000).selectExpr("CAST(nullif(id DIV 2, 7) AS string) AS k", "CAST(id AS double) AS o", "id % 2 * 0.1D AS u", "CAST(id DIV 2 AS double) AS v")
    monkeypatch.setattr(graph, "_CALLS", 16)
    apply, calls = type(d.groupBy("k")).applyInPandas, []

    def watch(self, f, schema):
        calls.append(self.agg({"*": "count"}).count())
        return apply(self, f, schema)

    monkeypatch.setattr(type(d.groupBy("k")), "applyInPandas", watch)
    got = graph.greedy_instances(d, ["k"], ("u", "v"), ["o"]).collect()
    want = [(None if i == 7 else str(i), 0, 0.05, float(i), 2) for i in range(9000)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert calls == [16]
