"""Line dedup and SimHash against brute force; their handling of odd inputs."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, queries, simhash
from plumbline.llm.vptree import Tree

ODD = "doc_id long, text string, `a.b` string, row string, keep string"
ROWS = [(1, "a b c\nx", "p", "q", "r"), (1, "a b c\nx", "p", "q", "r"), (None, None, None, None, None), (2, "", "p", None, "r"), (3, "A  b c\nx", "p", "q", "r"), (None, "x\n\n x ", "p", "q", "r"), (5, "word " * 30_000, "p", "q", "r")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


def key(line: str) -> bytes:
    return line.strip(" \t\n\x0b\x0c\r").encode().lower()


def kept_by_brute_force(rows, min_docs):
    where = collections.defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if key(line):
                where[key(line)].add((r.doc_id, r.text or ""))
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        keep = [x for x in lines if not (key(x) and len(where[key(x)]) >= min_docs)]
        out.append((r.doc_id, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts,batch", [(4, 10_000), (23, 7)])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_lines(spark, docs, odd, min_docs, parts, batch):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for d in (docs, odd):
            got = line_dedup.digests(d, line_dedup.keep_bitmaps(d, min_docs=min_docs)).collect()
            order = lambda x: (x[0] is None, x[0] or 0, x[1:])
            assert sorted(map(tuple, got), key=order) == sorted(kept_by_brute_force(d.collect(), min_docs), key=order)
            first = line_dedup.keep_bitmaps(d, min_docs=min_docs, keep_first=True).agg(F.sum("n_dropped")).first()[0]
            groups = collections.defaultdict(lambda: [set(), 0])
            for i, t in {(r.doc_id, r.text or "") for r in d.collect()}:
                for k in filter(None, map(key, t.split("\n"))):
                    groups[k][0].add((i, t))
                    groups[k][1] += 1
            assert first == sum(n - 1 for s, n in groups.values() if len(s) >= min_docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_bitmaps_restore_the_text(spark, odd):
    d = line_dedup.drop_lines(odd, line_dedup.keep_bitmaps(odd, min_docs=2))
    assert d.columns == odd.columns and d.count() == odd.count()
    assert sorted(r.text for r in d.filter("text is not null").collect())[:2] == ["", ""]
    assert d.filter("text is null").count() == 1


def test_line_query(spark, sf):
    from tests.oracle import assert_same, connect

    assert_same(queries.op3_line_dedup(spark, sf), connect(sf), queries.OP3_SQL)


def clusters_by_brute_force(pairs):
    fps = sorted({f for _, f in pairs})
    a, label = np.array(fps, np.uint64), list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
            x, y = root(i), root(int(j))
            label[max(x, y)] = min(x, y)
    at = {f: i for i, f in enumerate(fps)}
    least = {}
    for i, f in pairs:
        r = root(at[f])
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return {(i, f"{f:016x}", least.get(root(at[f]))) for i, f in pairs}


@pytest.mark.parametrize("shard_rows", [4096, 20])
def test_simhash(spark, docs, odd, monkeypatch, shard_rows):
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, bits: links(d, bits, shard_rows))
    monkeypatch.setattr(simhash, "LARGE_ROWS", shard_rows)
    for d in (docs, odd):
        got = simhash.near_duplicates(d).collect()
        assert len(got) == d.count()
        assert {tuple(r) for r in got} == clusters_by_brute_force([(r.doc_id, simhash.fingerprint((r.text or "").encode())) for r in d.collect()])


def test_fingerprint_hashes_as_spark_does(spark):
    h = spark.range(1).select(F.hex(F.xxhash64(F.lit("a b c")))).first()[0]
    assert f"{simhash.fingerprint(b'A b  c'):016X}" == h.zfill(16)
    assert simhash.fingerprint(b" \n") == 0


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 5, None]


def test_dense_groups_stay_small(spark):
    """A ball of a thousand fingerprints: its links come back as a star, not as pairs."""
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ (1 << i) for i in range(64)] + [base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]
    d = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    assert simhash.links(d, 2).count() <= len(fps)


def test_trees_find_every_pair():
    rng = np.random.default_rng(0)
    p = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    p = np.unique(np.concatenate((p, p[:500] ^ np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64), p[:100] ^ np.uint64(5))))
    want = int((np.bitwise_count(p[:, None] ^ p[None]) <= 2).sum())
    assert sum(len(a) for a, _ in Tree(p).pairs(p, 2)) == want
    top = Tree(rng.choice(p, 256, replace=False), leaf=1, max_leaves=16)
    i, shard, home = top.route(p, 2)
    at = {int(k): s for k, s in zip(i[home], shard[home], strict=True)}
    copies = {(int(k), int(s)) for k, s in zip(i, shard, strict=True)}
    for a, b in zip(*np.nonzero(np.bitwise_count(p[:, None] ^ p[None]) <= 2), strict=True):
        assert (int(a), int(at[int(b)])) in copies or (int(b), int(at[int(a)])) in copies


def test_empty_tables(spark, odd):
    e = odd.limit(0)
    assert line_dedup.keep_bitmaps(e).count() == 0
    assert simhash.near_duplicates(e).count() == 0 and simhash.keep_one(e).count() == 0
