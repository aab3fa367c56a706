"""SimHash near-duplicates: exact links at a Hamming distance through sharded vantage-point trees, then connected components.

1. Each text gives one 64-bit fingerprint; equal fingerprints collapse to one row before anything is compared, so a group of
   copies of any size costs one row.
2. A vantage-point tree over a bounded sample cuts Hamming space into shards. Each fingerprint is at home in one shard and is
   copied, as a query, to the shards whose region its ball overlaps (vptree.Tree.route), so that no pair is lost.
3. Each shard builds its own tree, finds its pairs by pruned search and returns a spanning star of each local component: never
   more rows than fingerprints, however many pairs there are.
4. Large-star/small-star joins the stars into components.

Null and empty texts have fingerprint zero and link like any other. Repeated rows are members like any other. An empty table gives
an empty result. Ids may be null or repeat; component_id is the least id that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, partitions, spare, stored, text_bytes
from .components import components
from .vptree import Labels, Tree

#: Fingerprints at home in a shard, more or less: as few as the first while the session has partitions for more shards, up to the second
#: otherwise, as the copies at the shards' borders grow with about the square root of their number; shards at most (they get larger then),
#: and sampled fingerprints a shard for the tree above the shards (8 MB in all).
SHARD_ROWS, LARGE_ROWS, MAX_SHARDS, SAMPLE = 4_096, 65_536, 65_536, 16
_x = xxhash.xxh64_intdigest


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return _x(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[shingle - 1 :].tolist()
    n = len(ends)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.fromiter(map(_x, [joined[a:b] for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=False)], repeat(42)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """_id, _th (xxhash64 of the text), fp (as a signed long), a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in batch.column("_text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(fp.view(np.int64))], ["_id", "_th", "fp"])

    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_th"), text_bytes(F.col(text_col).cast("string")).alias("_text"))
    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, _th long, fp long")


def links(distinct: DataFrame, bits: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) over a table of distinct fingerprints (fp) whose components are those of all pairs at ``bits`` or fewer differing bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = min(MAX_SHARDS, max(1, -(-n // LARGE_ROWS), min(-(-n // shard_rows), partitions(spark))))
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(shards * SAMPLE * 4 if shards < 64 else shards * SAMPLE).collect()
    top = Tree(np.array([r[0] for r in sample], np.int64).view(np.uint64), leaf=1, max_leaves=shards)
    top.order = top.points = np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast(top)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            i, shard, home = shared.value.route(fp, bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(fp[i].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        fp, home = rows.column("fp").to_numpy().view(np.uint64), rows.column("home").to_numpy()
        points = np.concatenate((fp[home], fp[~home]))
        k = int(home.sum())
        out = Labels(len(points))
        if k:
            for a, b in Tree(points[:k]).pairs(points, bits):
                out.link(a, b)
        linked = np.flatnonzero(out.label != np.arange(len(points)))
        yield pa.RecordBatch.from_arrays([pa.array(points[linked].view(np.int64)), pa.array(points[out.label[linked]].view(np.int64))], ["a", "b"])

    routed = distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(local, "a long, b long")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 2, shingle: int = 3) -> DataFrame:
    """_id, _th, fp, root (a fingerprint that names the component) and component_id, a row for each document."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints", per_core=16)
    reps = stored(fps.groupBy("fp").agg(F.min("_id").alias("least")), "distinct-fingerprints", per_core=4)
    comps = components(links(reps, bits))
    rooted = reps.join(comps, reps["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only components of two or more fingerprints need another look at their members
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select("_id", "_th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, a row for each document."""
    return clusters(docs, id_col, text_col, **options).select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are the first of their component (least id, nulls last), one row each, all columns as they are."""
    c = clusters(docs, id_col, text_col, **options)
    first = c.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("_null"), F.col("_id"), F.col("_th"))).alias("_k")).select(F.col("_k._id").alias("kept_id"), F.col("_k._th").alias("kept_th")).distinct()
    # ids as text, so that null is a key like any other: the join and the choice among equal rows share one shuffle
    id_key = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("n"))
    first = stored(first.select(id_key("kept_id").alias("k"), F.col("kept_th").alias("th")), "kept-ids", per_core=1)
    th, k = spare(docs, "th", "k")
    rows = docs.withColumns({th: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), k: id_key(id_col)})
    rows = rows.join(first.select(F.col("k").alias(k), F.col("th").alias(th)), [k, th], "left_semi")
    return rows.dropDuplicates([k, th]).select(*columns(docs))


__all__ = ["clusters", "discard", "fingerprint", "fingerprints", "keep_one", "links", "near_duplicates"]
