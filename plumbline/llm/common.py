"""Shared pieces: chunked access to Arrow text, vectorised word hashing, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09-\x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
IS_NEWLINE = np.zeros(256, bool)
IS_NEWLINE[10] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that the vectorised passes hold at once.
CHUNK = 2 << 20

#: Spans of more bytes than this are hashed one by one.
LANES = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e]: eight bytes of every span at a time, chained through a scrambling that isn't linear; XXH3 of long ones."""
    n = ends - starts
    out = mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    at, place, left = slice(None), starts, n
    for step in range(LANES // 8):
        x = lanes[place] & _KEEP[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ x) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step))
        go = np.flatnonzero(left > 8)
        if not len(go):
            break
        at = go if step == 0 else at[go]
        place, left = place[go] + 8, left[go] - 8
    for i in np.flatnonzero(n > LANES):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], 1)
    return out


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without separators) of concatenated texts, and how many each text has. No word spans two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~separator[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] |= solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = inner[inner > 0] - 1
    last[before] |= solid[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def text_pieces(data: np.ndarray, size: int, separator: np.ndarray = IS_SPACE) -> Iterator[np.ndarray]:
    """Consecutive slices of about ``size`` bytes that cut no word (run without separators); a separator ends none, it begins the next."""
    i = 0
    while i < len(data):
        j = min(len(data), i + size)
        while j < len(data):
            gap = np.flatnonzero(separator[data[j : j + 65536]])
            if len(gap):
                j += int(gap[0])
                break
            j = min(len(data), j + 65536)
        yield data[i:j]
        i = j


def per_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, one run a document (zero for empty runs)."""
    total = np.concatenate(([0], np.cumsum(values)))
    to = np.cumsum(counts)
    return total[to] - total[to - counts]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows again, at most so many bytes of text at once, or one row where its text is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = bytes_of(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def columns(df: DataFrame) -> list[Column]:
    """All columns under their names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_bytes(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a folder of this machine only where Spark runs on it alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not have.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
            have = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = have.get()
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


_made: list[str] = []


def stored(df: DataFrame, name: str, per_core: int | None = None) -> DataFrame:
    """The rows written once to the shared folder and read again: cuts the lineage and survives lost executors. ``per_core``: in so many
    files a core at most, for tables that would otherwise come in many tiny files."""
    path = new_path(df.sparkSession, name)
    _made.append(path)
    (df.coalesce(per_core * df.sparkSession.sparkContext.defaultParallelism) if per_core else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_plumbline_path", None)
    if path:
        if path in _made:
            _made.remove(path)
        _delete(df.sparkSession, path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows that make() gives, stored; the tables that it stored on the way are deleted."""
    before = len(_made)
    out = stored(make(), name)
    for path in _made[before:]:
        if path != out._plumbline_path:
            _made.remove(path)
            _delete(spark, path)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
