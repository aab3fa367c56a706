"""Hard negatives by ball-tree branch-and-bound over integer inner products.

Rows are dealt to shards, and each shard builds a ball tree: nodes hold a centre, a radius, and their label where all of their rows share one. For an
anchor q, every row of a node scores between q.centre - |q| radius and q.centre + |q| radius. Blocks of anchors walk a tree together, the side with the
greater bounds first; a node is left out for the anchors whose score window its bounds miss, whose current k-th score lies strictly above its upper bound
(rows that tie with the k-th are still looked at, as ids decide), or whose labels it can't hold. The search runs twice: for the positives, the best rows
of the anchor's own label; then for each positive's negatives, in the window of scores that its own score gives. What shards find is merged by anchor, a
few rows from each shard. Anchor blocks meet shards by an equality join on both numbers, so a task holds one shard and one block whatever the table's size.

Rows with a null label, a null vector, or a null or non-finite component take no part. Repeated rows are rows of their own: each is an anchor, a positive
or a negative, and only the anchor's own row is left out of its search. A null id is no anchor and comes last among ties. Vectors of different lengths are
compared as if the shorter one went on with zeros. Scores are exact; one beyond 64 bits is taken as the nearest long, and so is a component. An empty table
gives an empty result. Column names of the input don't matter beyond the three that are named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored

#: Rows of a shard, anchors of a block, rows of a leaf.
SHARD, BLOCK, LEAF = 8192, 4096, 64
TOP = 2**63 - 1
_NONE = -TOP
#: Products of norms up to which all sums of products of whole numbers are exact in double precision.
_EXACT = 2.0**52


class BallTree:
    """Nodes over rows sorted by position; a node's rows are start to end."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.start, self.end, self.left, self.right = [], [], [], []
        todo = [(0, len(x), -1, False)]
        while todo:
            a, z, parent, is_right = todo.pop()
            node = len(self.start)
            self.start.append(a)
            self.end.append(z)
            self.left.append(-1)
            self.right.append(-1)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            if z - a > leaf:
                rows = self.order[a:z]
                part = x[rows]
                axis = int(np.argmax(part.max(0) - part.min(0)))
                half = (z - a) // 2
                self.order[a:z] = rows[np.argpartition(part[:, axis], half)]
                todo += [(a + half, z, node, True), (a, a + half, node, False)]
        self.x, self.labels = x[self.order], labels[self.order]
        self.centre = np.stack([self.x[a:z].mean(0) for a, z in zip(self.start, self.end, strict=True)])
        spread = [np.sqrt(((self.x[a:z] - c) ** 2).sum(1).max()) for a, z, c in zip(self.start, self.end, self.centre, strict=True)]
        self.radius = np.array(spread) * (1 + 1e-9)
        self.size = np.sqrt((self.centre**2).sum(1))
        #: (all rows' label, True), or (-, False) where they differ
        self.one = np.array([bool((self.labels[a:z] == self.labels[a]).all()) for a, z in zip(self.start, self.end, strict=True)])
        self.label = self.labels[self.start]


def exact_scores(q: np.ndarray, x: np.ndarray, whole_q: np.ndarray, whole_x: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors as longs; pairs too large for double precision are worked out in Python's integers."""
    with np.errstate(invalid="ignore", over="ignore"):
        s = q @ x.T
        large = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :] >= _EXACT
    if not large.any():
        return s.astype(np.int64)
    out = np.where(large, 0, s).astype(np.int64)
    for i, j in zip(*np.nonzero(large), strict=True):
        out[i, j] = max(_NONE + 1, min(TOP, sum(int(a) * int(b) for a, b in zip(whole_q[i], whole_x[j], strict=True))))
    return out


def search(tree: BallTree, whole: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k best (score, id) rows inside low to high: (query number, score, position in the tree's order), unsorted.
    ``same``: rows of the query's label, else of others. whole, ids and rows are in the tree's order."""
    q = queries.astype(np.float64)
    norm = np.sqrt((q * q).sum(1))
    n = len(q)
    best, best_id, best_at = np.full((n, k), _NONE, np.int64), np.full((n, k), TOP, np.int64), np.full((n, k), -1, np.int64)

    def bounds(node: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid, reach = q[active] @ tree.centre[node], norm[active] * tree.radius[node]
        slack = 1e-9 * norm[active] * (tree.size[node] + tree.radius[node]) + 1
        return mid - reach - slack, mid + reach + slack

    def allowed(node: int, active: np.ndarray) -> np.ndarray:
        if tree.one[node]:
            active = active[(labels[active] == tree.label[node]) == same]
        lo, hi = bounds(node, active)
        return active[(hi >= np.maximum(low[active], best[active, k - 1])) & (lo <= high[active])]

    todo = [(0, np.flatnonzero(low <= high))]
    while todo:
        node, active = todo.pop()
        active = allowed(node, active)
        if not len(active):
            continue
        if tree.left[node] >= 0:
            sides = [tree.left[node], tree.right[node]]
            sides.sort(key=lambda x: float(bounds(x, active)[1].mean()))  # noqa: B023
            todo += [(x, active) for x in sides]
            continue
        a, z = tree.start[node], tree.end[node]
        s = exact_scores(q[active], tree.x[a:z], queries[active], whole[a:z])
        fits = ((tree.labels[a:z][None, :] == labels[active][:, None]) == same) & (rows[a:z][None, :] != own[active][:, None])
        fits &= (s >= low[active][:, None]) & (s <= high[active][:, None]) & (s >= best[active, k - 1][:, None])
        some = fits.any(1)
        if not some.any():
            continue
        active, s = active[some], np.where(fits[some], s[some], _NONE)
        score = np.concatenate((best[active], s), 1)
        name = np.concatenate((best_id[active], np.where(s > _NONE, ids[a:z][None, :], TOP)), 1)
        at = np.concatenate((best_at[active], np.where(s > _NONE, np.arange(a, z)[None, :], -1)), 1)
        order = np.lexsort((at < 0, name, -score), 1)[:, :k]
        best[active], best_id[active], best_at[active] = (np.take_along_axis(v, order, 1) for v in (score, name, at))
    of, place = np.nonzero(best_at >= 0)
    return of, best[of, place], best_at[of, place]


def _whole(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of longs as a matrix, filled up with zeros."""
    column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _group(k: int, same: bool):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["a", "p", "id", "r", "score"]
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        width = max(max(t.column("q").combine_chunks().value_lengths().to_pylist()) for t in (anchors, rows))
        whole, queries = _whole(rows.column("q"), width), _whole(anchors.column("q"), width)
        tree = BallTree(whole.astype(np.float64), rows.column("label").to_numpy())
        whole, ids, r = whole[tree.order], rows.column("id").to_numpy()[tree.order], rows.column("r").to_numpy()[tree.order]
        low, high, a, p = (anchors.column(c).to_numpy() for c in ("low", "high", "a", "p"))
        of, score, at = search(tree, whole, ids, r, queries, anchors.column("label").to_numpy(), a, low, high, k, same)
        return pa.table({"a": a[of], "p": p[of], "id": ids[at], "r": r[at], "score": score})

    return run


def _best(rows: DataFrame, anchors: DataFrame, k: int, same: bool, shards: int, blocks: int) -> DataFrame:
    """(a, p, id, r, score, rank): of all rows the k best of each (anchor row a, window p)."""
    n = min(shards * blocks, partitions(rows.sparkSession))
    left = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))
    right = rows.withColumn("shard", F.pmod(F.xxhash64("r"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pair = left.repartition(n, "shard", "block").groupBy("shard", "block").cogroup(right.repartition(n, "shard", "block").groupBy("shard", "block"))
    found = pair.applyInArrow(_group(k, same), "a long, p long, id long, r long, score long")
    rank = F.row_number().over(Window.partitionBy("a", "p").orderBy(F.desc("score"), "id", "r"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, relabel: Column | None = None) -> DataFrame:
    """r, id, label, q: the rows that take part, components as floor(scale * x)."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if relabel is None else relabel).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.filter("label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    bound = F.lit(float(2**62))
    q = F.transform("v", lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * F.lit(float(scale)), -bound), bound)), F.lit(-(2**62))), F.lit(2**62)))
    return v.select(F.monotonically_increasing_id().alias("r"), F.coalesce("id", F.lit(TOP)).alias("id"), "label", q.alias("q"))


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, anchors: Column, relabel: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and positive_rank.

    ``anchors``: a condition on the column ``id``; ``relabel``: the label to use in place of label_col. An anchor's positives are the best other rows of its
    label; a positive's negatives the best rows of other labels that score at least least_percent per cent of its score and no more than it.
    """
    rows = stored(whole_rows(vectors, id_col, vector_col, label_col, scale, relabel), "whole-vectors")
    chosen = stored(rows.filter(anchors & (F.col("id") != TOP)).select(F.col("r").alias("a"), F.col("id").alias("anchor_id"), "label", "q"), "anchors", per_core=1)
    n, m = rows.count(), chosen.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    ask = chosen.select("a", "label", "q", F.lit(0).cast("long").alias("p"), F.lit(_NONE + 1).alias("low"), F.lit(TOP).alias("high"))
    good = stored(_best(rows, ask, positives, True, shards, blocks), "positives", per_core=1)
    # per cent of the score, rounded up, without leaving 64 bits
    score = F.col("score")
    low = score - _share(score, 100 - least_percent)
    ask = good.select("a", F.col("rank").cast("long").alias("p"), low.alias("low"), score.alias("high")).join(chosen.select("a", "label", "q"), "a")
    bad = _best(rows, ask, negatives, False, shards, blocks)
    named = good.select("a", F.col("rank").cast("long").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = bad.select("a", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["a", "p"]).join(chosen.select("a", "anchor_id"), "a")
    real = lambda c: F.when(F.col(c) != TOP, F.col(c)).alias(c)
    return out.select("anchor_id", real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score", F.col("p").cast("int").alias("positive_rank"))


def _share(score: Column, percent: int) -> Column:
    """floor(score * percent / 100) in whole numbers, without leaving 64 bits."""
    rest = F.pmod(score, F.lit(100))
    return F.call_function("div", score - rest, F.lit(100)) * percent + F.call_function("div", rest * percent, F.lit(100))
