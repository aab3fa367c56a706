"""Vector best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Texts become token ids and pieces of at most ``tokens`` ids. A piece takes three resources of a sequence: tokens, one document, and
attention cost (its length squared). Pieces are placed longest first; each selects, among the open sequences that have room in every
resource, the one whose weighted residual norm after placing is least (or whose weighted dot product with the piece is greatest).

Pieces of one length are alike, so the plan needs only how many there are of each: sequences with equal residuals move as a block, and
the plan is a list of steps (length, so many sequences from this one on, so many pieces each, at this offset), a few for each length
whatever the corpus. The pieces are then numbered within their length (range partitioning, counts by partition) and look up their step. Numbered by id, the result
depends on the rows alone; numbered by place, it follows the order of the rows in their files, as a mix wants.

Null text is empty text: its one id is the end id. Texts of any length and any characters are encoded whole. Repeated rows and ids are packed
like any others. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import discard, partitions, stored, text_bytes

#: Fixed value: the pattern that cuts texts before byte-level BPE, as in the vocabulary file's ByteLevel step.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that the pattern above can't be matched against: its matcher gives up on runs of about a million characters.
_LONG_SPACE = 50_000
_encoders: dict[str, Encoder] = {}


def has_long_space(text: str, least: int = _LONG_SPACE) -> bool:
    """Whether a run of ``least`` white-space characters is in the text. Such a run covers a place divisible by ``least``, so only the runs there
    are measured, each at most ``least`` characters either way."""
    for i in range(0, len(text), least):
        if text[i].isspace():
            before, after = text[max(0, i - least) : i], text[i : i + least]
            if len(before) - len(before.rstrip()) + len(after) - len(after.lstrip()) >= least:
                return True
    return False


class Encoder:
    """Ids of a byte-level BPE vocabulary file. Texts without added tokens or very long white space go through the faster of two equal
    implementations."""

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        step = spec.get("pre_tokenizer") or {}
        self.fast = None
        if step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and not spec.get("normalizer"):
            self.fast = tiktoken.Encoding("plumbline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added) or has_long_space(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def piece_bounds(n: int, most: int) -> list[int]:
    """0, the cuts, n: whole pieces but the first, which takes the rest."""
    if n <= most:
        return [0, n]
    return [0, *range(n % most or most, n + 1, most)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, most: int = 1024, end_id: int = 2, with_ids: bool = False, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: a row for each piece, with the columns to carry of its document."""
    carry = carry or {}
    carried = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                ids = np.array([*encode((text.as_py() or b"").decode("utf-8", "replace")), end_id], "<u4")
                cuts = piece_bounds(len(ids), most)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            of = pa.array(row, pa.int64())
            arrays = [batch.column("doc_id").take(of), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), *(batch.column(c).take(of) for c in carried)], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), *carried])

    src = docs.select(F.col(id_col).alias("doc_id"), text_bytes(F.col(text_col).cast("string")).alias("_text"), *[v.alias(c) for c, v in carry.items()])
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + "".join(f", {c} {src.schema[c].dataType.simpleString()}" for c in carry))


def plan(counts: dict[int, int], tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), select: str = "norm") -> np.ndarray:
    """Steps (length, first rank, sequences, pieces in each, first sequence, offset) that place all pieces. Capacities hold in every sequence."""
    caps = np.array([tokens, documents, attention], np.float64)
    w = np.array(weights) / caps**2
    free = np.zeros((0, 3))
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps: list[tuple[int, ...]] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.float64)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        rank, left = 0, counts[length]
        while left:
            fits = (free >= need).all(1)
            if fits.any():
                score = (w * (free - need) ** 2).sum(1) if select == "norm" else -(w * free * need).sum(1)
                g = int(np.argmin(np.where(fits, score, np.inf)))
            else:  # open new sequences
                each = int((caps // need).min()) if select == "norm" else 1
                n = -(-left // each)
                g = len(first)
                free, first, many = np.vstack((free, caps)), np.append(first, sequences), np.append(many, n)
                sequences += n
            each = int((free[g] // need).min()) if select == "norm" else 1  # the sequence just chosen stays the best until it is full
            n = min(int(many[g]), left // each)
            take = each
            if not n:
                n, take = 1, left
            steps.append((length, rank, n, take, int(first[g]), tokens - int(free[g, 0])))
            rank += n * take
            left -= n * take
            after = free[g] - take * need
            if n < many[g]:
                free, first, many = np.vstack((free, after)), np.append(first, first[g]), np.append(many, n)
                first[g] += n
                many[g] -= n
            else:
                free[g] = after
    return np.array(steps, np.int64).reshape(-1, 6)


def _ranked(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows, each with its rank among the rows of its key (0, 1, ...), and the count of each key. Range partitioning lets a common key
    span partitions; what is added up afterwards is a count for each partition and key in it."""
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), key, *order).sortWithinPartitions(key, *order).withColumn("_m", F.monotonically_increasing_id())
    ordered = stored(ordered, "ranked", per_core=4)
    part = F.shiftright("_m", 33)
    each = ordered.groupBy(part.alias("_part"), F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.min("_m").alias("_least"))
    each = stored(each, "rank-offsets", per_core=1)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = each.withColumn("_before", before)
    ranked = ordered.withColumns({"_part": part, "_key": F.col(key)}).join(offsets, ["_part", "_key"])
    return ranked.withColumn("_rank", F.col("_m") - F.col("_least") + F.col("_before")).select(*rows.columns, "_rank"), each.groupBy("_key").agg(F.sum("_n").alias("n"))


def pack(rows: DataFrame, *, tokens: int = 1024, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), select: str = "norm", order: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """The pieces (with a column length, 1 to tokens) with sequence_id and offset. Without a limit on documents or attention cost, those that the
    tokens imply. Pieces of one length take their places by ``order``."""
    documents, attention = documents or tokens, attention or tokens * tokens
    ranked, counts = _ranked(rows, "length", [c for c in order if c in rows.columns])
    have = {int(r["_key"]): int(r["n"]) for r in counts.collect()}  # at most ``tokens`` rows
    steps = plan(have, tokens, documents, attention, weights, select)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    shared = rows.sparkSession.sparkContext.broadcast(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        keys = (s[:, 0] << 44) + s[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            step = s[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            k = rank - step[:, 1]
            arrays = [*batch.columns[:-1], pa.array(step[:, 4] + k // step[:, 3]), pa.array(step[:, 5] + k % step[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def row_place(docs: DataFrame) -> dict[str, Column]:
    """Columns that order the rows as they lie in files: by file name (longer ones last, as their part numbers are greater), then row in it;
    rows that come from no file as they come."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return {"_long": F.lit(0), "_file": F.lit(""), "_row": F.monotonically_increasing_id()}
    name = F.col("_metadata.file_name")
    return {"_long": F.length(name), "_file": name, "_row": F.col("_metadata.row_index")}


def renumbered(packed: DataFrame, order: list[str]) -> DataFrame:
    """The sequences numbered anew (0, 1, ...) by the place of their first piece in ``order``."""
    first = packed.groupBy("sequence_id").agg(F.min(F.struct(*order)).alias("_first")).select("sequence_id", "_first.*", F.lit(0).alias("_all"))
    ranked, _ = _ranked(first, "_all", order)
    numbers = ranked.select(F.col("sequence_id").alias("_old"), F.col("_rank").alias("_new"))
    joined = packed.join(numbers, packed["sequence_id"] == numbers["_old"])
    return joined.select(*[F.col("_new").alias(c) if c == "sequence_id" else F.col(c) for c in packed.columns])


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, tokens: int = 1024, documents: int | None = None, attention: int | None = None, end_id: int = 2, with_ids: bool = False, follow: bool = False) -> DataFrame:
    """Tokenises, cuts and packs; a piece is never longer than what one sequence's attention cost allows. With ``follow`` the order of the rows in
    their files decides: which of the pieces of one length comes first, and that sequences are numbered by their first piece."""
    most = min(tokens, isqrt(attention)) if attention else tokens
    place = row_place(docs) if follow else {}
    rows = stored(pieces(docs, tokenizer, id_col, text_col, most=most, end_id=end_id, with_ids=with_ids, carry=place), "pieces")
    if not follow:
        return pack(rows, tokens=tokens, documents=documents, attention=attention)
    order = [*place, "piece"]
    return renumbered(pack(rows, tokens=tokens, documents=documents, attention=attention, order=tuple(order)), order).drop(*place)


__all__ = ["Encoder", "discard", "encoder", "pack", "pack_documents", "piece_bounds", "pieces", "plan", "renumbered", "row_place"]
