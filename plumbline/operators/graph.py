"""Graphs as edge tables: connected components by stars, maximum spanning trees, greedy instances, fix-point merging."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TREE_EDGES = 1_000_000
#: Calls to which the keys of instances are dealt.
_CALLS = 4096
TILE = 256


def checkpoint_dir(spark: SparkSession) -> None:
    """Sees to a folder for checkpoints: spark.checkpoint.dir; one of this machine only where Spark runs on it alone."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that the driver and all executors share")
        sc.setCheckpointDir(where or "/tmp/checkpoints")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the session's own checkpoints where it is unset."""
    checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage as checkpoint() does, and with it the constraints that the optimiser would carry
    through every later join of tables that stem from one."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", keys: list[str] | None = None, rounds: int = 100) -> DataFrame:
    """keys, node, component (its least node): alternating large stars (all greater neighbours link to the least of a neighbourhood) and
    small stars (all lesser ones do), checkpointed, until no edge changes. The rounds grow with the logarithm of the nodes, whatever the
    diameter, and no round has more edges than the one before."""
    keys = keys or []
    checkpoint_dir(edges.sparkSession)
    ends = edges.select(*keys, F.greatest(a, b).alias("_x"), F.least(a, b).alias("_y")).distinct().checkpoint()
    nodes = ends.select(*keys, F.col("_x").alias("node")).unionByName(ends.select(*keys, F.col("_y").alias("node"))).distinct()
    now, before = ends.filter("_x <> _y"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(*keys, F.col("_y").alias("_x"), F.col("_x").alias("_y")))
        least = both.groupBy(*keys, "_x").agg(F.least(F.min("_y"), F.first("_x")).alias("_m"))
        large = both.filter("_y > _x").join(least, [*keys, "_x"]).select(*keys, F.col("_y").alias("_x"), F.col("_m").alias("_y")).filter("_x <> _y").distinct()
        small = large.groupBy(*keys, "_x").agg(F.min("_y").alias("_m"))
        rest = large.join(small, [*keys, "_x"]).filter("_y <> _m").select(*keys, F.col("_y").alias("_x"), F.col("_m").alias("_y"))
        now = rest.unionByName(small.select(*keys, "_x", F.col("_m").alias("_y"))).distinct().checkpoint()
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "_x", "_y").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    roots = now.select(*keys, F.col("_x").alias("node"), F.col("_y").alias("_root"))
    return nodes.join(roots, [*keys, "node"], "left").select(*keys, "node", F.coalesce("_root", "node").alias("component"))


def _tile_labels(r, c, diagonal: bool):
    """For each cell of a tile the place of the first cell (by row, then column) of its region; cells sorted by row, then column."""
    import numpy as np

    at = np.full((TILE + 1, TILE + 2), -1)
    at[r, c + 1] = np.arange(len(r))
    pairs = []
    for i, j in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else []):
        other = at[r + i, c + 1 + j]
        pairs.append((np.flatnonzero(other >= 0), other[other >= 0]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    label = np.arange(len(r))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (deeper := label[label]).tobytes() != label.tobytes():
            label = deeper


def cell_components(cells: DataFrame, r: str, c: str, keys: list[str], diagonal: bool) -> DataFrame:
    """cells with component: 4- or 8-connected regions of a sparse raster, per key. A cell is named by r * 2^20 + c (columns from -2^19 to
    2^19 - 1). Regions are labelled inside tiles of TILE x TILE cells first; what crosses tile borders is a graph of their labels."""
    import numpy as np

    checkpoint_dir(cells.sparkSession)
    tiles = cells.select(*keys, r, c).distinct().withColumns({"_tr": F.floor(F.col(r) / TILE), "_tc": F.floor(F.col(c) / TILE)})
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*keys, r, c).schema.fields)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([r, c])
        y, x = pdf[r].to_numpy(np.int64), pdf[c].to_numpy(np.int64)
        name = y * (1 << 20) + x
        return pdf[[*keys, r, c]].assign(_id=name, _local=name[_tile_labels(y % TILE, x % TILE, diagonal)])

    own = tiles.groupBy(*keys, "_tr", "_tc").applyInPandas(label, f"{head}, _id long, _local long").checkpoint()
    edge = lambda x: F.pmod(F.col(x), F.lit(TILE)).isin(0, TILE - 1)
    border = own.filter(edge(r) | edge(c))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    moved = border.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    moved = moved.select(*keys, F.col("_local").alias("_a"), ((F.col(r) + F.col("_s.i")) * F.lit(1 << 20) + F.col(c) + F.col("_s.j")).cast("long").alias("_id"))
    links = moved.join(border.select(*keys, "_id", "_local"), [*keys, "_id"]).select(*keys, F.col("_a").alias("a"), F.col("_local").alias("b")).filter("a <> b").distinct().checkpoint()
    if links.isEmpty():
        return own.withColumnRenamed("_local", "component").drop("_id")
    comp = connected_components(links, keys=keys).withColumnRenamed("node", "_local")
    return own.join(comp, [*keys, "_local"], "left").select(*keys, r, c, F.coalesce("component", "_local").alias("component"))


def max_spanning_forest(edges: DataFrame, a: str, b: str, weight: str, keys: list[str]) -> DataFrame:
    """keys, a, b, weight: the maximum spanning forest of each key's graph (ties: lower nodes first). Graphs of links between photos or
    rooms are small; one that exceeds MAX_TREE_EDGES is refused."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.select(*keys, a, b, weight).schema.fields)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_TREE_EDGES:
            raise ValueError("too many edges for one tree")
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        keep = []
        for i, x, y in pdf.sort_values([weight, a, b], ascending=[False, True, True])[[a, b]].itertuples():
            rx, ry = root(x), root(y)
            keep.append(rx != ry)
            parent[rx] = ry
        order = pdf.sort_values([weight, a, b], ascending=[False, True, True])
        return order[keep][[*keys, a, b, weight]]

    return edges.groupBy(*keys).applyInPandas(tree, out)


def spanning_order(edges: DataFrame, a: str, b: str, weight: str, keys: list[str], start: str) -> DataFrame:
    """keys, node, parent, step: Prim's order from each key's ``start`` node, heaviest link first; nodes it doesn't reach have no row."""
    kind = edges.schema[a].dataType.simpleString()
    head = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys)

    def prim(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for x, y, w in pdf[[a, b, weight]].itertuples(index=False):
            near.setdefault(x, []).append((y, w))
            near.setdefault(y, []).append((x, w))
        first = pdf[start].iloc[0]
        done, rows = {first}, [(first, None, 0)]
        while True:
            best = max(((w, x, y) for x in done for y, w in near.get(x, ()) if y not in done), default=None, key=lambda t: (t[0],))
            if best is None:
                break
            done.add(best[2])
            rows.append((best[2], best[1], len(rows)))
        out = pd.DataFrame(rows, columns=["node", "parent", "step"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return edges.groupBy(*keys).applyInPandas(prim, f"{head}{', ' * bool(keys)}node {kind}, parent {kind}, step int")


class _Median:
    """A running median of weighted values that are known by their places in a sorted array: counts by place in a Fenwick tree that holds only what it has."""

    def __init__(self, values):
        self.values, self.tree, self.total, self.top = values, {}, 0, 1 << max(0, len(values).bit_length() - 1)

    def add(self, place: int, n: int) -> None:
        self.total += n
        i = place + 1
        while i <= len(self.values):
            self.tree[i] = self.tree.get(i, 0) + n
            i += i & -i

    def _nth(self, n: int) -> float:
        at, step = 0, self.top
        while step:
            if at + step <= len(self.values) and (have := self.tree.get(at + step, 0)) < n:
                at, n = at + step, n - have
            step >>= 1
        return self.values[at]

    def median(self) -> float:
        return (self._nth((self.total + 1) // 2) + self._nth(self.total // 2 + 1)) / 2


def greedy_instances(sightings: DataFrame, keys: list[str], xy: tuple[str, str], order: list[str], *, radius: float = 0.6, views: int = 2) -> DataFrame:
    """keys, instance, u, v, views: sightings in order (give a total one) join the first instance whose median place so far lies within the
    radius, else they found one; instances seen in fewer than ``views`` go. Sequential by nature, per key (capture and class), many keys to a call. Equal sightings are counted
    together: they follow one another and join the same instance, as each draws its median nearer to them. The medians are kept by running counts, and the
    instances near a place are found by cells of the radius."""
    head = ", ".join(f"`{k}` {sightings.schema[k].dataType.simpleString()}" for k in keys)

    def cluster(us: list, vs: list, ns: list) -> list[tuple]:
        """instance, u, v, views of one key's places in their order."""
        import math

        import numpy as np

        places = []
        for xs in (us, vs):
            values = sorted({x for x in xs if math.isfinite(x)})
            at = {x: i for i, x in enumerate(values)}
            places.append((values, [at.get(x, -1) for x in xs]))
        found: list[list] = []  # medians of u and v, their counts, cell, views
        near: dict = {}
        cell = lambda u, v: (math.floor(u / radius), math.floor(v / radius))
        for u, v, iu, iv, n in zip(us, vs, places[0][1], places[1][1], ns, strict=True):
            if iu < 0 or iv < 0:  # near nothing
                found += [[u, v, None, None, None, 1] for _ in range(n)]
                continue
            a, b = cell(u, v)
            ids = [x for i in (-1, 0, 1) for j in (-1, 0, 1) for x in near.get((a + i, b + j), ())]
            x = min((x for x in ids if np.hypot(found[x][0] - u, found[x][1] - v) < radius), default=len(found))
            if x == len(found):
                found.append([u, v, _Median(places[0][0]), _Median(places[1][0]), None, 0])
            m = found[x]
            m[2].add(iu, n)
            m[3].add(iv, n)
            m[0], m[1], m[5] = m[2].median(), m[3].median(), m[5] + n
            if (at := cell(m[0], m[1])) != m[4]:
                near.get(m[4], set()).discard(x)
                near.setdefault(at, set()).add(x)
                m[4] = at
        return [(i, m[0], m[1], m[5]) for i, m in enumerate(found) if m[5] >= views]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.assign(_g=pdf.groupby(keys, sort=False, dropna=False).ngroup()).sort_values(["_g", *order])
        starts = np.flatnonzero(np.diff(pdf["_g"].to_numpy(), prepend=-1)).tolist()
        us, vs, ns = (pdf[c].to_numpy(t).tolist() for c, t in ((xy[0], float), (xy[1], float), ("_n", np.int64)))
        rows = [(i, *r) for i, j in zip(starts, [*starts[1:], len(pdf)], strict=True) for r in cluster(us[i:j], vs[i:j], ns[i:j])]
        out = pd.DataFrame(rows, columns=["_at", "instance", "u", "v", "views"])
        own = pdf[keys].iloc[out["_at"].to_numpy(np.int64)].reset_index(drop=True)
        return pd.concat([own, out.drop(columns="_at")], axis=1)

    alike = sightings.groupBy(*dict.fromkeys([*keys, *order, *xy])).agg(F.count("*").alias("_n"))
    # many keys a call: a call for each costs more than its few rows do
    return alike.groupBy(F.pmod(F.xxhash64(*keys), F.lit(_CALLS))).applyInPandas(run, f"{head}, instance int, u double, v double, views int")
