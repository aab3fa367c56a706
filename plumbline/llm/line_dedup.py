"""Line deduplication: range-partitioned line hashes, secondary sort, streamed groups, keep bitmaps.

Every line's key (stripped, A-Z lower-cased) becomes a 128-bit hash. The hashes are range-partitioned on (hash, document), so
that one very common line spans several partitions, and sorted by hash, document and position. Each partition is streamed once:
a group that reaches ``min_docs`` documents is decided on the spot and none is ever held beyond ``min_docs`` documents. Only the
groups at a partition's two ends can go on next door; their counts, two rows a partition at most, are added up afterwards.
What comes back is one bitmap a document, deflated, never text.

A document is a (doc_id, text) pair: rows repeated as a whole count once and get the same bitmap. Null text is empty text, which is
one empty line. A null doc_id is an id like any other. An empty table gives an empty result. Very long texts and texts of very many lines are read in
pieces of CHUNK bytes; beside the text a task holds FLUSH rows, and a byte a line while it applies a bitmap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK, IS_NEWLINE, SPACES, bytes_of, columns, partitions, spare, stored, text_bytes, text_pieces

#: Rows that a task holds before it sends them on.
FLUSH = 50_000
_ROW = "hi long, lo long, pos int, n_lines int"
#: A row to drop; one whose group goes on next door; the first row there of such a group; such a group's count of documents.
DROP, OPEN, FIRST, COUNT = 1, 2, 3, 4


def line_keys(min_chars: int, size: int = CHUNK):
    """Rows of a document's lines: each line whose key is long enough, then the header (pos -1, with the number of lines). At most FLUSH rows and a
    piece of ``size`` bytes of a text are held as Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = bytes_of(batch.column("_text"))
            parts: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                pos = 0
                for lines in line_pieces(data[offsets[i] : offsets[i + 1]], size):
                    for line in lines:
                        key = line.strip(SPACES).lower()
                        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                            d = xxhash.xxh3_128_intdigest(key)
                            for part, x in zip(parts, (i, d >> 64, d & 0xFFFFFFFFFFFFFFFF, pos, 0), strict=True):
                                part.append(x)
                        pos += 1
                        if len(parts[0]) >= FLUSH:
                            yield _flush(batch, parts)
                            parts = [[], [], [], [], []]
                for part, x in zip(parts, (i, 0, 0, -1, pos), strict=True):
                    part.append(x)
            yield _flush(batch, parts)

    return run


def line_pieces(data: np.ndarray, size: int) -> Iterator[list[bytes]]:
    """The lines of a text, a few at a time."""
    if not len(data):
        yield [b""]
        return
    for k, piece in enumerate(text_pieces(data, size, IS_NEWLINE)):
        lines = piece.tobytes().split(b"\n")
        yield lines[1:] if k else lines  # later pieces begin with the line break that ends the one before


def _flush(batch: pa.RecordBatch, parts: list[list]) -> pa.RecordBatch:
    take = pa.array(parts[0], pa.int32())
    hi, lo = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in parts[1:3])
    return pa.RecordBatch.from_arrays([batch.column("_id").take(take), batch.column("_th").take(take), hi, lo, pa.array(parts[3], pa.int32()), pa.array(parts[4], pa.int32())], ["_id", "_th", "hi", "lo", "pos", "n_lines"])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[0] = True
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def stream_groups(min_docs: int, keep_first: bool):
    """Streams sorted (hash, document, position) rows and says of each what becomes of it: the first batch's first group and the last
    group may go on in the next partition, so they also yield their count (and first row). Rows are held only while their group has
    under min_docs documents."""
    columns = ["_id", "_th", "hi", "lo", "pos"]

    def emit(rows: pa.RecordBatch, state: int, docs: int = 0) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(np.full(n, state, np.int8)), pa.array(np.full(n, docs, np.int64))], [*columns, "state", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, last_doc, lead = None, 0, None, True
        held: list[pa.RecordBatch] = []
        first: pa.RecordBatch | None = None

        def feed(rows: pa.RecordBatch, n_docs: int) -> Iterator[pa.RecordBatch]:
            nonlocal docs, held
            docs += n_docs
            held.append(rows)
            if docs >= min_docs:
                yield from (emit(x, DROP) for x in held if x.num_rows)
                held = []

        def begin(rows: pa.RecordBatch, n_docs: int) -> Iterator[pa.RecordBatch]:
            nonlocal key, docs, held, first
            key, docs, held, first = (rows.column("hi")[0].as_py(), rows.column("lo")[0].as_py()), 0, [], rows.slice(0, 1)
            yield from feed(rows.slice(1) if keep_first else rows, n_docs)

        def close(at_end: bool) -> Iterator[pa.RecordBatch]:
            if lead or at_end:
                yield emit(first, COUNT, docs)
                if keep_first:
                    yield emit(first, FIRST)
                yield from (emit(x, OPEN) for x in held if x.num_rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, th = (batch.column(c).to_numpy() for c in ("hi", "lo", "_th"))
            ids = batch.column("_id")
            new_group = _starts(hi, lo)
            new_doc = new_group | _starts(th) | _changes(ids)
            cont = key == (int(hi[0]), int(lo[0]))
            doc = (ids[0].as_py(), int(th[0]))
            new_doc[0] = not (cont and doc == last_doc)
            last_doc = (ids[-1].as_py(), int(th[-1]))
            at = [*np.flatnonzero(new_group), batch.num_rows]
            total = np.concatenate(([0], np.cumsum(new_doc)))
            i = 0
            if cont:
                yield from feed(batch.slice(0, at[1]), int(total[at[1]]))
                i = 1
            while i < len(at) - 1:
                if key is not None:
                    yield from close(False)
                    lead = False
                    if (rest := len(at) - 2 - i) > 0:  # groups that begin and end here
                        a, z = at[i], at[-2]
                        n_docs = np.diff(total[at[i:-1]])
                        drop = np.repeat(n_docs >= min_docs, np.diff(at[i:-1]))
                        if keep_first:
                            drop &= ~new_group[a:z]
                        if drop.any():
                            yield emit(batch.slice(a, z - a).filter(pa.array(drop)), DROP)
                        i += rest
                yield from begin(batch.slice(at[i], at[i + 1] - at[i]), int(total[at[i + 1]] - total[at[i]]))
                i += 1
        if key is not None:
            yield from close(True)

    return run


def _changes(ids: pa.Array) -> np.ndarray:
    """True where an id differs from the one before; nulls are alike."""
    out = np.ones(len(ids), bool)
    if len(ids) > 1:
        a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] = ~(same | pc.and_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False))
    return out


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, drops in zip(batch.column("n_lines").to_pylist(), batch.column("_drops"), strict=True):
            bits = np.ones(n, np.uint8)
            if drops.is_valid:
                bits[drops.values.to_numpy()] = 0
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(out, pa.binary())], ["_id", "_th", "n_lines", "n_dropped", "keep"])


def kept_pieces(data: np.ndarray, n_lines: int, keep: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """The text without the lines that the bitmap drops, in pieces."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines, bitorder="little").astype(bool)
    at, held = 0, b""
    pieces = text_pieces(data, size, IS_NEWLINE) if len(data) else [data]
    for k, piece in enumerate(pieces):
        body = np.concatenate((piece[1:] if k else piece, np.array([10], np.uint8)))  # every line with its break
        ends = np.flatnonzero(body == 10) + 1
        kept = body[np.repeat(bits[at : at + len(ends)], np.diff(ends, prepend=0))].tobytes()
        at += len(ends)
        if kept:
            yield held
            held = kept
    yield held[:-1]  # the last line's break isn't one between lines


def kept_lines(text: bytes | None, n_lines: int, keep: bytes) -> bytes:
    """The text without the lines that the bitmap drops."""
    return b"".join(kept_pieces(np.frombuffer(text or b"", np.uint8), n_lines, keep))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """One row a document (distinct id and text): _id, _th (xxhash64 of the text), n_lines, n_dropped, keep (deflated bitmap, first line lowest bit).

    Lines whose key has at least ``min_chars`` code points and stands in at least ``min_docs`` documents are dropped: all of them,
    or with ``keep_first`` all but the first by (hash order of) document and position.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    id_type = src.schema["_id"].dataType.simpleString()
    rows = src.select("_id", "_th", text_bytes("_text").alias("_text")).mapInArrow(line_keys(min_chars), f"_id {id_type}, _th long, {_ROW}")
    rows = stored(rows, "line-keys")
    heads = rows.filter("pos = -1").select("_id", "_th", "n_lines").distinct()
    lines = rows.filter("pos >= 0").select("_id", "_th", "hi", "lo", "pos")
    n = partitions(spark)
    ranged = lines.repartitionByRange(n, "hi", "lo", "_id", "_th").sortWithinPartitions("hi", "lo", "_id", "_th", "pos")
    marks = stored(ranged.mapInArrow(stream_groups(min_docs, keep_first), f"_id {id_type}, _th long, hi long, lo long, pos int, state byte, docs long"), "line-marks")
    # groups over a boundary: a sum of at most two counts a partition
    spans = marks.filter(F.col("state") == COUNT).groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.count("*").alias("parts"))
    spans = spans.filter((F.col("docs") >= min_docs) & (F.col("parts") > 1))
    decided = marks.filter(F.col("state") == DROP).select("_id", "_th", "pos")
    late = marks.filter(F.col("state").isin(OPEN, FIRST)).join(spans.select("hi", "lo"), ["hi", "lo"], "left_semi")
    if keep_first:  # of the first rows, one a partition, the least stays
        first = marks.filter(F.col("state") == FIRST).groupBy("hi", "lo").agg(F.min(F.struct("_id", "_th", "pos")).alias("_first"))
        late = late.join(first, ["hi", "lo"]).filter(F.struct("_id", "_th", "pos") != F.col("_first"))
    drops = decided.unionByName(late.select("_id", "_th", "pos")).distinct()
    drops = drops.groupBy("_id", "_th").agg(F.collect_list("pos").alias("_drops"))
    joined = heads.join(drops, heads["_id"].eqNullSafe(drops["_id"]) & (heads["_th"] == drops["_th"]), "left").select(heads["_id"], heads["_th"], F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.size("_drops") > 0, F.col("_drops")).alias("_drops"))
    return joined.mapInArrow(_bitmap, T.StructType([T.StructField("_id", src.schema["_id"].dataType), *T._parse_datatype_string("_th long, n_lines long, n_dropped long, keep binary").fields]))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, their text replaced by the kept lines, joined by a newline. Only texts that lose lines cross to Python."""

    @F.arrow_udf("binary")
    def kept(text: pa.Array, n: pa.Array, keep: pa.Array) -> pa.Array:
        return pa.array([kept_lines(t.as_py(), k.as_py(), b.as_py()) if b.is_valid else t.as_py() for t, k, b in zip(text, n, keep, strict=True)], pa.binary())

    th, b_id, b_th, n, keep, new = spare(docs, "th", "b_id", "b_th", "n", "keep", "new")
    b = bitmaps.filter("n_dropped > 0").select(F.col("_id").alias(b_id), F.col("_th").alias(b_th), F.col("n_lines").alias(n), F.col("keep").alias(keep))
    d = docs.withColumn(th, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    j = d.join(b, d[id_col].eqNullSafe(F.col(b_id)) & (F.col(th) == F.col(b_th)), "left")
    text = kept(F.when(F.col(keep).isNotNull(), F.col(text_col).cast("binary")), F.col(n), F.col(keep)).cast("string")
    j = j.withColumn(new, F.when(F.col(keep).isNull(), F.col(text_col)).otherwise(text))
    return j.select(*[F.col(new).alias(c) if c == text_col else x for c, x in zip(docs.columns, columns(docs), strict=True)])


def digests(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text, one row for each row of docs."""

    @F.arrow_udf("string")
    def sha(text: pa.Array, n: pa.Array, keep: pa.Array) -> pa.Array:
        data, offsets = bytes_of(text)
        out = []
        for i, (k, b) in enumerate(zip(n, keep, strict=True)):
            digest = hashlib.sha256()
            for piece in kept_pieces(data[offsets[i] : offsets[i + 1]], k.as_py(), b.as_py()):
                digest.update(piece)
            out.append(digest.hexdigest())
        return pa.array(out, pa.string())

    b = bitmaps.select(F.col("_id").alias("b_id"), F.col("_th").alias("b_th"), "n_lines", "n_dropped", "keep")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("d_th", F.xxhash64("_text"))
    j = d.join(b, d["doc_id"].eqNullSafe(F.col("b_id")) & (F.col("d_th") == F.col("b_th")))
    return j.select("doc_id", "n_lines", "n_dropped", sha(F.col("_text").cast("binary"), F.col("n_lines"), F.col("keep")).alias("kept_sha256"))
