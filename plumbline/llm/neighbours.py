"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search answers queries on it.

Equal vectors are one node, whatever their number; a node keeps the ids of its first ``keep`` members, which is all that a list of
nearest rows can need. Every table, however small, takes the same way: random blocks, rounds, search. Nodes and their original vectors
are written to the shared folder, in shards that executors map into memory. Each round joins every node's neighbours (and, of the nodes that point at it, at most as many), compares their vectors with each other
(neighbours of neighbours), proposes what is nearer than a node's farthest neighbour, and keeps the nearest; ids travel, vectors are read
from the files, distances are in double precision. Rounds end when under ``stop`` of the graph changes. The same is done for a quarter
of the nodes, a quarter of these, and so on, so that links lead from group to group. A query walks from the thinnest graph's nodes, and
from its own node where it is in the index, to the nearest unexpanded nodes, a beam of ``beam`` at a time.

Vectors that are null, zero, hold a null or a non-finite component, or differ in length from the commonest length take no part. An id
that repeats counts with each of its vectors. With at most ``keep`` candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, new_path, partitions, stored
from .elias_fano import read_arrays, write_arrays
from .language_model import local_path

DEGREE, BEAM, BLOCK, SHARD, ROUNDS, STOP = 24, 400, 1024, 8192, 15, 0.02
STARTS, EXPAND = 512, 8
BROADCAST_NODES = 1 << 20  # of 16 bytes each
_files: dict[str, list[dict]] = {}


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """id (least of the node's members), vec, members (the first ``keep``)."""
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("vec")).filter(F.col("_id").isNotNull() & F.col("vec").isNotNull())
    v = v.filter(F.expr("size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vec, x -> x <> 0)"))
    v = v.withColumn("vec", F.expr("transform(vec, x -> x + CAST(0 AS FLOAT))") if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col("vec").cast("array<double>"))
    common = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    v = v.filter(F.size("vec") == (common[0]["n"] if common else 0))
    first = v.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("_id"))).filter(F.col("_n") <= keep)
    return stored(first.groupBy("vec").agg(F.min("_id").alias("id"), F.sort_array(F.collect_list("_id")).alias("members")), "ann-nodes")


def _matrix(column: pa.ChunkedArray | pa.Array, n: int, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(kind)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of each matrix."""
    s = (x * x).sum(-1)
    return s[..., :, None] + s[..., None, :] - 2 * np.matmul(x, np.swapaxes(x, -1, -2))


def _nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray, new: np.ndarray, degree: int) -> tuple[np.ndarray, ...]:
    """Of rows (a, b) the nearest distinct b of each a, sorted; a row that isn't new goes before its equal."""
    o = np.lexsort((new, b, a))
    a, b, d, new = a[o], b[o], d[o], new[o]
    one = np.ones(len(a), bool)
    one[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, d, new = a[one], b[one], d[one], new[one]
    o = np.lexsort((b, d, a))
    a, b, d, new = a[o], b[o], d[o], new[o]
    begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
    k = rank < degree
    return a[k], b[k], d[k], new[k]


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of sorted rows in which no group is split."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows >= least:
            t = pa.concat_tables(held)
            k = t.column(key).to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield t.slice(0, cut)
                t = t.slice(cut)
            held, rows = [t.combine_chunks()], t.num_rows
    if rows:
        yield pa.concat_tables(held)


def _graph_batch(a, b, d, new) -> pa.RecordBatch:
    begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(a)))
    radius = np.repeat(d[begin + size - 1], size) if len(a) else d
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.float64)), pa.array(new), pa.array(radius.astype(np.float64)), pa.array(np.repeat(size, size).astype(np.int32))], ["id", "nb", "dist", "new", "radius", "n"])


_GRAPH = "id long, nb long, dist double, new boolean, radius double, n int"


def first_graph(nodes: DataFrame, n: int, degree: int) -> DataFrame:
    """Each node's nearest in two random blocks; with one alone no join would ever leave its block."""
    blocks = max(1, n // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("id")
        ids = t.column("id").to_numpy()
        x = _matrix(t.column("vec"), len(ids), np.float64)
        for i in range(0, len(ids), 512):
            s = (x * x).sum(1)
            d = s[i : i + 512, None] + s[None] - 2 * x[i : i + 512] @ x.T
            rows = np.arange(len(d))
            d[rows, rows + i] = np.inf
            k = min(degree, len(ids) - 1)
            if k < 1:
                continue
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            a, b = np.repeat(ids[i : i + 512], k), ids[near.ravel()]
            yield _graph_batch(*_nearest(a, b, np.take_along_axis(d, near, 1).ravel(), np.ones(len(a), bool), degree))

    def of(k: int) -> DataFrame:
        return nodes.select(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(blocks)).cast("int").alias("block"), "id", "vec").groupBy("block").applyInArrow(run, _GRAPH)

    return merged(of(1).unionByName(of(2)), degree) if blocks > 1 else of(1)


def merged(edges: DataFrame, degree: int) -> DataFrame:
    """The nearest distinct neighbours of each node."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "id"):
            yield _graph_batch(*_nearest(*(t.column(c).to_numpy() for c in ("id", "nb", "dist", "new")), degree))

    return edges.select("id", "nb", "dist", "new").repartition(partitions(edges.sparkSession), "id").sortWithinPartitions("id").mapInArrow(merge, _GRAPH)


def descend(graph: DataFrame, index: dict, n: int, degree: int, round_: int) -> DataFrame:
    """One round: local joins at every node, then the nearest of old and proposed neighbours. Vectors are read from the index's files. The
    nodes' radii are broadcast up to BROADCAST_NODES nodes; of more they are joined by node, where adaptive execution splits the rows of a
    node that very many point at."""
    parts = partitions(graph.sparkSession)
    pointed = graph.select(F.col("nb").alias("u"), F.col("id").alias("m"), "new")
    w = Window.partitionBy("u").orderBy(F.desc("new"), F.xxhash64("m", F.lit(round_)))
    pointed = pointed.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= degree).drop("_n")
    members = graph.select(F.col("id").alias("u"), F.col("nb").alias("m"), "new").unionByName(pointed)
    reach = graph.groupBy("id").agg(F.max("radius").alias("radius"), F.max("n").alias("n"))
    known = reach.select(F.col("id").alias("m"), F.when(F.col("n") < degree, F.lit(float("inf"))).otherwise(F.col("radius")).alias("radius"))
    met = members.join(F.broadcast(known) if n <= BROADCAST_NODES else known, "m").repartition(parts, "u").sortWithinPartitions("u", "m")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(index)
        for t in _whole_groups(batches, "u"):
            u, m, new = (t.column(c).to_numpy() for c in ("u", "m", "new"))
            one = np.ones(len(u), bool)
            one[1:] = (u[1:] != u[:-1]) | (m[1:] != m[:-1])
            begin = np.flatnonzero(one)
            fresh = np.maximum.reduceat(new.astype(np.uint8), begin) > 0
            u, m, radius = u[begin], m[begin], t.column("radius").to_numpy()[begin]
            own, where = np.unique(m, return_inverse=True)
            x = shards.vectors(own)
            start = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            size = np.diff(np.append(start, len(u)))
            found: list[list[np.ndarray]] = [[], [], []]
            for i in range(0, len(start), 128):
                s, z = start[i : i + 128], size[i : i + 128]
                at = np.minimum(s[:, None] + np.arange(z.max()), len(u) - 1)
                real = np.arange(z.max()) < z[:, None]
                d = np.maximum(_squares(x[where[at]]), 0)
                ok = (d < radius[at][:, :, None]) & (fresh[at][:, :, None] | fresh[at][:, None, :]) & real[:, :, None] & real[:, None, :]
                ok &= ~np.eye(z.max(), dtype=bool)
                g, a, b = np.nonzero(ok)
                for out, got in zip(found, (m[at[g, a]], m[at[g, b]], d[g, a, b]), strict=True):
                    out.append(got)
            a, b, d = (np.concatenate(f) for f in found)
            a, b, d, _ = _nearest(a, b, d, np.ones(len(a), bool), degree)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d), pa.array(np.ones(len(a), bool))], ["id", "nb", "dist", "new"])

    proposed = met.mapInArrow(join, "id long, nb long, dist double, new boolean")
    both = graph.select("id", "nb", "dist", F.lit(False).alias("new")).unionByName(proposed)
    return merged(both, degree)


def write_nodes(nodes: DataFrame, n: int) -> dict:
    """The index without links: folder and number of shards. A shard's file holds its nodes' ids, vectors, members and the hashes of vectors."""
    shards = max(1, -(-n // SHARD))
    folder = local_path(new_path(nodes.sparkSession, "ann"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
        if t.num_rows:
            shard = t.column("shard")[0].as_py()
            vec, members = (t.column(c).combine_chunks() for c in ("vec", "members"))
            x = vec.flatten().to_numpy(zero_copy_only=False)
            hashes = _hashes(x.reshape(t.num_rows, -1))
            o = np.argsort(hashes)
            out = {"ids": t.column("id").to_numpy(), "vec": x, "hash": hashes[o], "hash_at": o, "members": members.flatten().to_numpy(zero_copy_only=False)}
            write_arrays(f"{folder}/{shard}", out | {"members_at": np.concatenate(([0], np.cumsum(members.value_lengths().to_numpy())))})
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(vec[0])], pa.int32())], ["shard", "dim"])

    rows = nodes.select(F.pmod("id", F.lit(shards)).cast("int").alias("shard"), "id", "vec", "members")
    got = rows.groupBy("shard").applyInArrow(write, "shard int, dim int").collect()  # a row a shard
    return {"folder": folder, "shards": shards, "have": sorted(r["shard"] for r in got), "dim": max((r["dim"] for r in got), default=0)}


def neighbour_graph(nodes: DataFrame, n: int, index: dict, degree: int, rounds: int, stop: float) -> DataFrame:
    graph = stored(first_graph(nodes, n, degree), "ann-graph")
    for r in range(rounds):
        after = stored(descend(graph, index, n, degree, r), "ann-graph")
        discard(graph)
        graph = after
        if after.filter("new").count() <= stop * n * degree:
            break
    return graph


def build(nodes: DataFrame, *, degree: int = DEGREE, rounds: int = ROUNDS, stop: float = STOP) -> dict:
    """The index: write_nodes()'s, a file of links beside each shard's, and the starts. Links are the neighbours (both ways) in the graph of all
    nodes, of a quarter of them by hash, of a quarter of that, and so on: the thinner graphs' links lead from group to group. The nodes of the
    thinnest, at most ``STARTS``, are the starts."""
    n = nodes.count()
    index = write_nodes(nodes, n)
    graphs: list[DataFrame] = []
    some, have, layer = nodes, n, 0
    while True:
        graphs.append(neighbour_graph(some, have, index, degree, rounds, stop))
        if have <= STARTS:
            break
        layer += 1
        some = nodes.filter(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(4**layer)) == 0)
        have = some.count()
    index["starts"] = sorted(r["id"] for r in (some if have else nodes.limit(STARTS)).select("id").collect())
    links = None
    for graph in graphs:
        turned = graph.select(F.col("nb").alias("id"), F.col("id").alias("nb"), "dist")
        turned = turned.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nb"))).filter(F.col("_n") <= 2 * degree)
        both = graph.select("id", "nb").unionByName(turned.select("id", "nb"))
        links = both if links is None else links.unionByName(both)
    links = links.groupBy("id").agg(F.collect_set("nb").alias("links"))  # at most three times the degree for each graph that the node is in
    shards, folder = index["shards"], index["folder"]
    rows = nodes.select("id").join(links, "id", "left").select(F.pmod("id", F.lit(shards)).cast("int").alias("shard"), "id", F.coalesce("links", F.array().cast("array<long>")).alias("links"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
        if t.num_rows:
            shard = t.column("shard")[0].as_py()
            a = t.column("links").combine_chunks()
            write_arrays(f"{folder}/links-{shard}", {"links": a.flatten().to_numpy(zero_copy_only=False), "links_at": np.concatenate(([0], np.cumsum(a.value_lengths().to_numpy())))})
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

    rows.groupBy("shard").applyInArrow(write, "shard int").collect()  # a row a shard
    for graph in graphs:
        discard(graph)
    return index


def _hashes(x: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in np.ascontiguousarray(x, np.float64) + 0.0], np.uint64)


class Shards:
    """The mapped files of the nodes."""

    def __init__(self, index: dict):
        self.shards, self.dim = index["shards"], index["dim"]
        key = index["folder"]
        if key not in _files:
            _files.clear()
            _files[key] = [read_arrays(f"{key}/{s}") if s in index["have"] else {"ids": np.zeros(0, np.int64)} for s in range(self.shards)]
        self.files = _files[key]

    def places(self, ids: np.ndarray) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """For each shard its file, the places there of its ids, and which ids these are."""
        shard = np.mod(ids, self.shards)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            yield self.files[s], np.searchsorted(self.files[s]["ids"], ids[at]), at

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        out = np.empty((len(ids), self.dim))
        for f, i, at in self.places(ids):
            out[at] = f["vec"].reshape(-1, self.dim)[i]
        return out

    def lists(self, ids: np.ndarray, field: str) -> list[np.ndarray]:
        out: list = [None] * len(ids)
        for f, i, at in self.places(ids):
            for a, k in zip(at, i, strict=True):
                out[a] = f[field][f[f"{field}_at"][k] : f[f"{field}_at"][k + 1]]
        return out


class Graph(Shards):
    """The nodes with their links."""

    def __init__(self, index: dict):
        super().__init__(index)
        for s in index["have"]:
            if "links" not in self.files[s]:
                self.files[s].update(read_arrays(f"{index['folder']}/links-{s}"))
        self.starts = np.array(index["starts"], np.int64)
        self.start_vectors = self.vectors(self.starts)

    def same(self, x: np.ndarray) -> np.ndarray:
        """The node that is equal to the vector, if there is one."""
        h = _hashes(x[None])[0]
        out = []
        for f in self.files:
            if len(f["ids"]):
                i = int(np.searchsorted(f["hash"], h))
                if i < len(f["hash"]) and f["hash"][i] == h:
                    out.append(f["ids"][f["hash_at"][i]])
        return np.array(out, np.int64)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes found, nearest first, and their distances."""
        own = np.setdiff1d(self.same(x), self.starts)
        ids = np.concatenate((self.starts, own))
        seen = np.sort(ids)
        dist = ((np.concatenate((self.start_vectors, self.vectors(own))) - x) ** 2).sum(1)
        done = np.zeros(len(ids), bool)
        while True:
            o = np.lexsort((ids, dist))[:beam]
            ids, dist, done = ids[o], dist[o], done[o]
            go = np.flatnonzero(~done)[:EXPAND]
            if not len(go):
                return ids, np.sqrt(dist)
            done[go] = True
            near = np.unique(np.concatenate(self.lists(ids[go], "links")))
            near = near[seen[np.minimum(np.searchsorted(seen, near), len(seen) - 1)] != near]
            seen = np.sort(np.concatenate((seen, near)))
            ids = np.concatenate((ids, near))
            dist = np.concatenate((dist, ((self.vectors(near) - x) ** 2).sum(1)))
            done = np.concatenate((done, np.zeros(len(near), bool)))


def search(queries: DataFrame, index: dict, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows but itself, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(index) if index["have"] else None
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for q, v in zip(batch.column("_q").to_pylist(), batch.column("_v"), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and graph else np.zeros(0)
                if graph is None or len(x) != graph.dim or not np.isfinite(x).all() or not x.any():
                    continue
                if (key := x.tobytes()) not in known:
                    if len(known) > 1000:
                        known.clear()
                    ids, dist = graph.search(x, max(beam, k + 1))
                    ids, dist = ids[: k + 1], dist[: k + 1]
                    members = graph.lists(ids, "members")
                    known[key] = np.concatenate(members), np.repeat(dist, [len(m) for m in members])
                ids, dist = known[key]
                other = ids != q
                ids, dist = ids[other], dist[other]
                o = np.lexsort((ids, dist))[:k]
                out[0] += [q] * len(o)
                out[1] += range(1, len(o) + 1)
                out[2] += ids[o].tolist()
                out[3] += dist[o].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], ["query_id", "rank", "vec_id", "score"])

    rows = queries.select(F.col(id_col).cast("long").alias("_q"), F.col(vector_col).alias("_v")).filter(F.col("_q").isNotNull())
    return rows.repartition(partitions(queries.sparkSession), "_q").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    return search(queries, build(nodes_of(vectors, id_col, vector_col, k + 1), degree=degree), id_col, vector_col, k=k, beam=beam)
