"""Substring deduplication by De Bruijn compaction: long repeated word sequences leave every text.

1. **Edges.** A window of ``window`` words is an edge of the graph whose nodes are the windows one word shorter. A chunk of texts sends each of its
   distinct edges once, with one letter (eight bits of a word's hash, zero at a text's end) for what precedes and follows it, or a mark where these
   differ inside the chunk. Edges are dealt to shards by their minimizer (the least hash of their half-length word sequences): neighbours in
   the text share one, so a run of edges sends it once and four bytes for each edge.
2. **Compaction.** A shard says of every edge that occurs twice or more whether the graph branches before or after it. The marks are joined to
   their chunks, and consecutive repeated edges without a branch between them become one path. Text ends count as branches, so all occurrences of
   a path's edges lie in whole occurrences of the path.
3. **Verification.** Paths are joined to their source texts; each occurrence gives a 128-bit digest of its words at its coordinates. A digest seen
   twice or more proves the repeat. What stays alone (a collision of hashes or letters) is decided window by window with two further hashes.

Words inside a verified window go. Everything that meets in one place is bounded: a chunk's text, a shard of about ``SHARD_BYTES`` of text, the paths
of one document; a passage in a third of all rows comes once from each chunk and its paths are counted with map-side combination.

A document is a (doc_id, text) row; equal rows are repeats of each other and give equal results. Null text has no words. Texts under ``window`` words
stay whole. Very long texts are read in pieces of CHUNK bytes; a piece's borders make no difference. A null doc_id is an id like any other. An empty
table gives an empty result. Column names of the input don't matter beyond the two that are named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, IS_SPACE, bytes_of, mix, partitions, span_hashes, stored, text_bytes, text_pieces, words

#: Bytes of text whose edges one shard decides at once; the tables' sum gives the number of shards.
SHARD_BYTES = 8 << 20
#: Unverified edges that may be broadcast as one sorted array (8 bytes each); more are joined.
BROADCAST_EDGES = 1 << 20
HEAD, COPIES, EDGES, MARKS = 0, 1, 2, 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A path in a document: first window, number of windows, whether what precedes and follows may belong to it, how often it occurs (255 at most).
_PATH = np.dtype([("s", "<i8"), ("n", "<i8"), ("b", "?"), ("a", "?"), ("c", "u1")])


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values, by doubling; each step scrambles, so nothing is linear."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while k >= size:
        if k & size:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out * _A + part)
            done += size
        power = mix(power[:-size] * _B + power[size:]) if len(power) > size else power[:0]
        size *= 2
    return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def word_hashes(data: np.ndarray, offsets: np.ndarray | None = None, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and how many each text has; with a salt another function (of the bytes combined with it)."""
    starts, ends, counts = words(data, np.array([0, len(data)]) if offsets is None else offsets)
    return span_hashes(data ^ np.uint8(salt) if salt else data, starts, ends), counts


class Words:
    """Word hashes of consecutive texts or parts of texts. A part may begin or end with a word that only serves as a neighbour."""

    def __init__(self, rows: np.ndarray, h: np.ndarray, counts: np.ndarray, first: int = 0, before: bool = False, after: bool = False):
        self.rows, self.h, self.counts, self.first, self.before, self.after = rows, h, counts, first, before, after

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a window begins (index into h), its place among the words of its text or part, and the count of windows of each."""
        c = self.counts
        local = np.arange(len(self.h)) - np.repeat(np.cumsum(c) - c, c)
        ok = (local >= self.before) & (local <= np.repeat(c, c) - k - self.after)
        at = np.flatnonzero(ok)
        return at, local[at], np.maximum(c - k + 1 - self.before - self.after, 0)


def word_parts(batches: Iterator[pa.RecordBatch], k: int, size: int, salt: int = 0) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Chunks of whole texts, and long texts in overlapping parts such that every window lies in just one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = bytes_of(batch.column("_text"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            part = data[offsets[i] : offsets[j]]
            if len(part) <= size:
                h, counts = word_hashes(part, offsets[i : j + 1] - offsets[i], salt)
                yield batch, Words(np.arange(i, j), h, counts)
            else:
                held, base, done = np.zeros(0, np.uint64), 0, 0
                it = text_pieces(part, size)
                piece = next(it)
                while piece is not None:
                    following = next(it, None)
                    h, _ = word_hashes(piece, None, salt)
                    held = np.concatenate((held, h))
                    last = following is None
                    to = base + len(held) - k + last
                    if to > done:
                        a, b = done - (done > 0) - base, to + k - 1 + (not last) - base
                        yield batch, Words(np.array([i]), held[a:b], np.array([b - a]), done, done > 0, not last)
                        done = to
                    keep = max(0, done - 1) - base
                    held, base = held[keep:], base + keep
                    piece = following
            i = j


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, all lowest first; what is small compresses well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b.reshape(4, -1).T).view("<u4").ravel()


def _runs(*breaks: np.ndarray) -> np.ndarray:
    """Starts of runs; a break at i stands between i and i + 1."""
    cut = breaks[0]
    for b in breaks[1:]:
        cut = cut | b
    return np.concatenate(([0], np.flatnonzero(cut) + 1))


def _table(kind: int, chunk: int, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    empty = {"shard": pa.int32(), "blob": pa.binary(), "_th": pa.int64(), "w": pa.int64(), "first": pa.int32(), "m": pa.int32()}
    arrays = {"kind": pa.array(np.full(n, kind, np.int8)), "chunk": pa.array(np.full(n, chunk, np.int64))}
    arrays |= {c: columns.get(c, pa.nulls(n, t)) for c, t in empty.items()}
    return pa.RecordBatch.from_pydict(arrays | {"_id": columns["_id"]})


_COLUMNS = ["kind", "chunk", "shard", "blob", "_th", "w", "first", "m", "_id"]


def _schema(id_type: str) -> str:
    return f"kind byte, chunk long, shard int, blob binary, _th long, w long, first int, m int, _id {id_type}"


def edge_rows(k: int, shards: int, size: int, bits: int):
    """For each chunk of texts its directory (a row a text), the windows that repeat an earlier one of the chunk, and its distinct edges by shard."""
    half, mask = (k + 1) // 2, np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in word_parts(batches, k, size):
            at, local, m = w.windows(k)
            if not len(at):
                continue
            e = rolled(w.h, k)[at] & mask
            low = least(rolled(w.h, half) & mask, k - half + 1)[at]
            letter = (w.h >> np.uint64(56)) % np.uint64(255) + np.uint64(1)
            letter = letter.astype(np.uint8)
            wide = np.concatenate(([0], letter, [0])).astype(np.uint8)
            prev = np.where(local > 0, wide[at], 0).astype(np.uint8)
            size_of = np.repeat(w.counts, m)
            following = np.where(local + k < size_of, wide[np.minimum(at + k, len(w.h)) + 1], 0).astype(np.uint8)

            order = np.argsort(e, kind="stable")
            s, r = e[order], low[order]
            begin = _runs(s[1:] != s[:-1], r[1:] != r[:-1])  # colliding edges of different minimizers stay apart
            many = np.diff(np.append(begin, len(s)))
            first = order[begin]
            p, f = prev[order], following[order]
            mixed = (np.minimum.reduceat(p, begin) != np.maximum.reduceat(p, begin)) * np.uint8(2) + (np.minimum.reduceat(f, begin) != np.maximum.reduceat(f, begin)) * np.uint8(4)
            flags = (mixed | (many > 1)).astype(np.uint8)
            total = np.minimum(many, 255).astype(np.uint8)

            rows = w.rows[m > 0]
            used = m[m > 0]
            ids = batch.column("_id").take(pa.array(rows))
            chunk = int(np.uint64(xxhash.xxh3_64_intdigest(e.tobytes() + repr((w.first, used.tolist(), ids.to_pylist())).encode())).view(np.int64))
            home = (used * 40503 + np.arange(len(used)) + (chunk >> 11)) % shards
            nulls = batch.column("_id").slice(0, 1).take(pa.array([None], pa.int32()))
            out = [_table(HEAD, chunk, shard=pa.array(home.astype(np.int32)), _id=ids, _th=batch.column("_th").take(pa.array(rows)), w=pa.array(np.full(len(rows), w.first, np.int64)), first=pa.array((np.cumsum(used) - used).astype(np.int32)), m=pa.array(used.astype(np.int32)))]
            if len(first) < len(e):  # windows that repeat an earlier one, as runs with the same distance
                source = np.empty(len(e), np.int64)
                source[order] = np.repeat(first, many)
                later = np.flatnonzero(source != np.arange(len(e)))
                back = later - source[later]
                starts = _runs(np.diff(later) != 1, np.diff(back) != 0)
                table = np.stack((later[starts], back[starts], np.diff(np.append(starts, len(later))))).astype("<u4")
                out.append(_table(COPIES, chunk, shard=pa.array(home[:1].astype(np.int32)), blob=pa.array([table.tobytes()]), _id=nulls))

            seat = np.argsort(first)
            first, flags, total, e_of = first[seat], flags[seat], total[seat], e[first[seat]]
            low = low[first]
            shard = ((mix(low) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cut = _runs(np.diff(shard[order]) != 0)
            blobs, to = [], []
            for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
                i = order[a:b]
                runs = _runs(low[i][1:] != low[i][:-1])
                parts = [np.array([len(i), len(runs)], "<u4").tobytes(), low[i][runs].astype("<u8").tobytes(), _planes(np.diff(np.append(runs, len(i)))), _planes(e_of[i].astype(np.uint32)), prev[first[i]].tobytes(), following[first[i]].tobytes(), flags[i].tobytes(), total[i].tobytes(), _planes(np.diff(first[i], prepend=0))]
                blobs.append(b"".join(parts))
                to.append(shard[i[0]])
            out.append(_table(EDGES, chunk, shard=pa.array(np.array(to, np.int32)), blob=pa.array(blobs, pa.binary()), _id=nulls.take(pa.array(np.zeros(len(to), np.int32)))))
            yield from (x.select(_COLUMNS) for x in out)

    return run


class _Blob:
    def __init__(self, raw: memoryview):
        b = np.frombuffer(raw, np.uint8)
        n, r = (int(x) for x in b[:8].view("<u4"))
        at = 8

        def next_bytes(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return b[at - size : at]

        low = next_bytes(8 * r).view("<u8") if r else np.zeros(0, np.uint64)
        lengths = _unplanes(next_bytes(4 * r))
        e = _unplanes(next_bytes(4 * n)).astype(np.uint64)
        self.key = mix(np.repeat(low, lengths) ^ mix(e * _A + np.uint64(7)))
        self.prev, self.following, self.flags, self.total = (next_bytes(n) for _ in range(4))
        self.at = np.cumsum(_unplanes(next_bytes(4 * n)))


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and kind: directories and copies pass; a shard's edges become marks of the repeated ones, a row for each chunk."""
    shard, blobs, chunks = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        if not blobs:
            return
        sizes = np.array([len(b.key) for b in blobs])
        key, prev, following, flags, total = (np.concatenate([getattr(b, c) for b in blobs]) for c in ("key", "prev", "following", "flags", "total"))
        order = np.argsort(key)
        s = key[order]
        begin = _runs(s[1:] != s[:-1])
        p, f, g = prev[order], following[order], flags[order]
        branch = np.bitwise_or.reduceat(g, begin)
        pb = (np.minimum.reduceat(p, begin) != np.maximum.reduceat(p, begin)) | (branch & 2 > 0) | (np.minimum.reduceat(p, begin) == 0)
        nb = (np.minimum.reduceat(f, begin) != np.maximum.reduceat(f, begin)) | (branch & 4 > 0) | (np.minimum.reduceat(f, begin) == 0)
        count = np.minimum(np.add.reduceat(total[order].astype(np.int64), begin), 255)
        mark = np.where(count > 1, 1 + 2 * pb + 4 * nb, 0).astype(np.uint8)
        many = np.diff(np.append(begin, len(s)))
        marks, counts = np.empty(len(s), np.uint8), np.empty(len(s), np.uint8)
        marks[order], counts[order] = np.repeat(mark, many), np.repeat(count, many).astype(np.uint8)
        to = np.cumsum(sizes)
        for b, chunk, a, z in zip(blobs, chunks, to - sizes, to, strict=True):
            i = np.flatnonzero(marks[a:z])
            if len(i):
                blob = _planes(np.diff(b.at[i], prepend=0)) + marks[a:z][i].tobytes() + counts[a:z][i].tobytes()
                yield _table(MARKS, chunk, blob=pa.array([blob], pa.binary()), _id=nulls).select(_COLUMNS)

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        passing = kind != EDGES
        if passing.any():
            yield batch.filter(pa.array(passing)).select(_COLUMNS)
        nulls = batch.column("_id").slice(0, 1).take(pa.array([None], pa.int32())) if batch.num_rows else None
        for i in np.flatnonzero(~passing):
            now = batch.column("shard")[i].as_py()
            if now != shard:
                yield from close()
                shard, blobs, chunks = now, [], []
            blobs.append(_Blob(batch.column("blob")[i].as_buffer()))
            chunks.append(batch.column("chunk")[i].as_py())
    yield from close()


def path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk and kind: a chunk's marks meet its directory and become the paths of each text."""
    chunk, heads, copies, marks = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if not heads or not marks:
            return
        head = pa.Table.from_batches(heads).combine_chunks()
        first, m, w = (head.column(c).to_numpy() for c in ("first", "m", "w"))
        n = int((first + m).max())
        mark, count = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        for raw in marks:
            b = np.frombuffer(raw, np.uint8)
            z = len(b) // 6
            at = np.cumsum(_unplanes(b[: 4 * z]))
            mark[at], count[at] = b[4 * z : 5 * z], b[5 * z :]
        for raw in copies:
            later, back, size = np.frombuffer(raw, "<u4").reshape(3, -1).astype(np.int64)
            to = np.repeat(later, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            source = to - np.repeat(back, size)
            mark[to], count[to] = mark[source], count[source]
        at = np.flatnonzero(mark)
        if not len(at):
            return
        distinct = np.argsort(first, kind="stable")  # a chunk that occurs twice has its directory twice
        of = distinct[np.searchsorted(first[distinct], at, "right") - 1]
        same = _runs(np.diff(at) != 1, np.diff(of) != 0, (mark[at[:-1]] & 4) > 0, (mark[at[1:]] & 2) > 0, np.diff(count[at].astype(int)) != 0)
        last = np.append(same[1:], len(at)) - 1
        row = of[same]
        bounds = np.concatenate((_runs(np.diff(row) != 0), [len(row)]))
        paths = np.empty(len(same), _PATH)
        paths["s"], paths["n"], paths["c"] = at[same] - first[row] + w[row], at[last] - at[same] + 1, count[at[same]]
        paths["b"], paths["a"] = mark[at[same]] & 2 == 0, mark[at[last]] & 4 == 0
        take = pa.array(row[bounds[:-1]])
        blobs = pa.array([paths[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([head.column("_id").combine_chunks().take(take), head.column("_th").combine_chunks().take(take), blobs], ["_id", "_th", "paths"])

    for batch in batches:
        ids, kinds, blobs = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy(), batch.column("blob")
        cut = [*_runs(np.diff(ids) != 0), len(ids)] if len(ids) else [0]
        for a, b in zip(cut, cut[1:], strict=False):
            if int(ids[a]) != chunk:
                yield from close()
                chunk, heads, copies, marks = int(ids[a]), [], [], []
            if (kinds[a:b] == HEAD).any():
                heads.append(batch.slice(a, b - a).filter(pa.array(kinds[a:b] == HEAD)))
            copies += [blobs[int(i)].as_buffer() for i in a + np.flatnonzero(kinds[a:b] == COPIES)]
            marks += [blobs[int(i)].as_buffer() for i in a + np.flatnonzero(kinds[a:b] == MARKS)]
    yield from close()


def joined(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths (start, windows) in order, each once; those that only a part's border cuts are one."""
    paths = np.unique(paths)
    s, n, b, a, c = (paths[x] for x in ("s", "n", "b", "a", "c"))
    if not len(s):
        return s, n
    begin = _runs(s[1:] != s[:-1] + n[:-1], ~a[:-1], ~b[1:], c[1:] != c[:-1])
    return s[begin], np.add.reduceat(n, begin)


def covered(s: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans of words (start, end) that the windows cover; paths are sorted."""
    if not len(s):
        return s, s
    to = s + n + k - 1
    begin = _runs(s[1:] > np.maximum.accumulate(to)[:-1])
    return s[begin], np.maximum.reduceat(to, begin)


def measured(data: np.ndarray, s: np.ndarray, n: np.ndarray, k: int, size: int) -> tuple[int, int, str, list[tuple[int, int, int, int, int]]]:
    """(words, removed words, SHA-256 of what stays, distinct digests of the paths as (start, windows, high, low, times)) of one text, read in pieces."""
    a_of, z_of = covered(s, n, k)
    removed = int((z_of - a_of).sum())
    sha, any_kept, at = hashlib.sha256(), False, 0
    found: dict[tuple[int, int], list[int]] = {}
    active: list[tuple[int, object]] = []
    ahead = 0
    for piece in text_pieces(data, size):
        starts, ends, _ = words(piece, np.array([0, len(piece)]))
        if not len(starts):
            continue
        length = ends - starts
        place = np.cumsum(length + 1) - length - 1
        solid = ~IS_SPACE[piece]
        solid[ends[:-1]] = True
        text = piece[solid]
        text[place[1:] - 1] = 32
        to = at + len(starts)

        def part(a: int, z: int) -> np.ndarray:
            return text[place[a - at] : place[z - 1 - at] + length[z - 1 - at]]  # noqa: B023

        i, j = np.searchsorted(z_of, at, "right"), np.searchsorted(a_of, to, "left")
        edge = [at, *np.stack((a_of[i:j], z_of[i:j]), 1).ravel().tolist(), to]
        for a, z in zip(edge[::2], edge[1::2], strict=True):
            a, z = max(a, at), min(z, to)
            if a < z:
                sha.update(b" " * any_kept)
                sha.update(part(a, z))
                any_kept = True
        while ahead < len(s) and s[ahead] < to:
            active.append((ahead, xxhash.xxh3_128()))
            ahead += 1
        rest = []
        for r, digest in active:
            a, z = max(int(s[r]), at), min(int(s[r] + n[r] + k - 1), to)
            if a > s[r]:
                digest.update(b" ")
            digest.update(part(a, z))
            if z < s[r] + n[r] + k - 1:
                rest.append((r, digest))
            else:
                key = (digest.intdigest(), int(n[r]))
                found.setdefault(key, [int(s[r]), 0])[1] += 1
        active = rest
        at = to
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return at, removed, sha.hexdigest(), [(start, m, signed(d >> 64), signed(d & (1 << 64) - 1), times) for (d, m), (start, times) in found.items()]


def _apply(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = bytes_of(batch.column("_text"))
            out = []
            for i, paths in enumerate(batch.column("paths")):
                s, n = joined(np.frombuffer(b"".join(paths.as_py() or ()), _PATH))
                out.append(measured(data[offsets[i] : offsets[i + 1]], s, n, k, size))
            digests = pa.array([[dict(zip(("s", "n", "hi", "lo", "times"), d, strict=True)) for d in x[3]] for x in out], pa.list_(pa.struct([(c, pa.int64()) for c in ("s", "n", "hi", "lo", "times")])))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), *(pa.array([x[i] for x in out], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))), digests], ["_id", "_th", "n_words", "n_removed", "kept_sha256", "digests"])

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return src.select("_id", F.xxhash64("_text").alias("_th"), text_bytes("_text").alias("_text"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


def compacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 35, size: int = CHUNK, bits: int = 64) -> DataFrame:
    """(_id, _th, paths): for each document with repeated edges the compacted paths that run through it, each part's as records of _PATH. Candidates:
    hashes decide."""
    src = _source(docs, id_col, text_col)
    id_type = src.schema["_id"].dataType.simpleString()
    n = partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    shards = max(n, -(-total // SHARD_BYTES))
    edges = src.mapInArrow(edge_rows(window, shards, size, bits), _schema(id_type))
    dealt = edges.repartition(n, "shard").sortWithinPartitions("shard", "kind")
    marks = dealt.mapInArrow(decide, _schema(id_type))
    by_chunk = marks.repartition(n, "chunk").sortWithinPartitions("chunk", "kind")
    paths = by_chunk.mapInArrow(path_rows, f"_id {id_type}, _th long, paths binary")
    return paths.groupBy("_id", "_th").agg(F.collect_set("paths").alias("paths"))


def window_rows(k: int, size: int, wanted: Broadcast | None = None):
    """(edge, two more hashes, id, text hash, place) of every window, or of those whose edge is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, w), (_, v) in zip(word_parts([batch], k, size), word_parts([batch], k, size, 0x55), strict=True):
                at, local, m = w.windows(k)
                e = rolled(w.h, k)[at]
                keep = np.arange(len(at)) if wanted is None else np.flatnonzero(np.isin(e, wanted.value))
                if not len(keep):
                    continue
                row = pa.array(np.repeat(w.rows, m)[keep])
                hashes = e, rolled(v.h, k)[at], rolled(mix(w.h ^ _A), k)[at]
                place = pa.array((local[keep] - w.before + w.first).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[keep].view(np.int64)) for x in hashes), batch.column("_id").take(row), batch.column("_th").take(row), place], ["edge", "hi", "lo", "_id", "_th", "s"])

    return run


def _one_by_one(src: DataFrame, docs: DataFrame, k: int, size: int) -> DataFrame:
    """(_id, _th, paths) of the documents (_id, _th): each window that does occur elsewhere, by its edge and two further hashes over its words."""
    spark, id_type = src.sparkSession, src.schema["_id"].dataType.simpleString()
    schema = f"edge long, hi long, lo long, _id {id_type}, _th long, s long"
    theirs = stored(src.join(docs, _same(src, docs), "left_semi").mapInArrow(window_rows(k, size), schema).distinct(), "doubtful")
    edges = theirs.select("edge").distinct()
    if edges.count() <= BROADCAST_EDGES:
        wanted = spark.sparkContext.broadcast(np.array([r["edge"] for r in edges.collect()], np.int64).view(np.uint64))
        everywhere = src.mapInArrow(window_rows(k, size, wanted), schema)
    else:
        everywhere = src.mapInArrow(window_rows(k, size), schema).join(edges, "edge", "left_semi")
    twice = everywhere.groupBy("edge", "hi", "lo").agg(F.count("*").alias("times")).filter("times > 1")
    good = theirs.join(twice, ["edge", "hi", "lo"], "left_semi").groupBy("_id", "_th").agg(F.collect_list("s").alias("s"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for starts in batch.column("s"):
                p = np.zeros(len(starts), _PATH)
                p["s"], p["n"] = starts.values.to_numpy(), 1
                blobs.append([p.tobytes()])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(blobs, pa.list_(pa.binary()))], ["_id", "_th", "paths"])

    return good.mapInArrow(paths, f"_id {id_type}, _th long, paths array<binary>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 35, size: int = CHUNK, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by a space), and spans: the removed paths of the document as struct(s, n),
    first word and number of windows. A row for each row of docs. ``bits``: of the edges' hashes, for tests."""
    src = _source(docs, id_col, text_col)
    id_type = src.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, _th long, n_words long, n_removed long, kept_sha256 string, digests array<struct<s:long,n:long,hi:long,lo:long,times:long>>"
    paths = stored(compacted(docs, id_col, text_col, window=window, size=size, bits=bits), "paths")

    def applied(rows: DataFrame, p: DataFrame) -> DataFrame:
        j = rows.join(p, _same(rows, p), "left").select(rows["_id"], rows["_th"], "_text", "paths")
        return j.mapInArrow(_apply(window, size), schema)

    out = stored(applied(src, paths), "kept")
    d = out.select("_id", "_th", F.explode("digests").alias("d")).select("_id", "_th", "d.*")
    alone = d.groupBy("hi", "lo", "n").agg(F.sum("times").alias("times"), F.min(F.struct("_id", "_th", "s")).alias("at")).filter("times = 1")
    alone = stored(alone.select("at.*", "n"), "alone-paths", per_core=1)
    if not alone.isEmpty():
        touched = stored(alone.select("_id", "_th").distinct(), "touched", per_core=1)
        again = applied(src.join(touched, _same(src, touched), "left_semi"), _one_by_one(src, touched, window, size))
        out = out.join(touched, _same(out, touched), "left_anti").unionByName(again)
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", F.transform("digests", lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"))).alias("spans"))
