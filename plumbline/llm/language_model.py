"""N-gram language model in an Elias-Fano trie, memory-mapped from the shared folder.

Orders one to three. Level 1 holds the words' 64-bit hashes (an Elias-Fano sequence a shard) and their counts; a word's number is its
place in it. Level 2 holds, for each word, its successors; level 3, for each kept pair, its successors, each given relative to its context:
by its place among the successors of the pair's second word, a small number. Within a level the successor numbers of one
context follow those of the one before, shifted by what has gone before, so that a whole level is one monotone sequence, searched by
value; the pointers are monotone too. Probabilities and back-off weights are bytes into a table of 256 quantiles.

Smoothing: add-one for words, p1 = (c + 1) / (N + V + 1); above that interpolated absolute discounting,
p(w | h) = (c(hw) - D) / c(h) + weight(h) p(w | h'), for every pair and triple of the training texts; the weight is
what these leave, so that every distribution sums to one (up to quantisation).

Building takes a pass over the training texts for each level. A task counts its own n-grams (sorted, summed) and sends them, delta-coded
byte planes, to the shard of their first word, or for triples of their first pair; a shard's task merges them and writes its file. Each pass looks the words, or pairs, of
its candidates up in the level before. Nothing of the model passes through the driver but a row for each shard. Scoring maps the files.

Null text is empty text: its one token is the end. Repeated rows count and score as often as they stand there. Without training texts
all counts are zero. The shared folder must be one that executors can open as files (file: or a mounted path).
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bytes_of, chunks, fold, mix, new_path, partitions, per_doc, span_hashes, text_bytes, words
from .elias_fano import EliasFano, encode, read_arrays, write_arrays

DISCOUNT = 0.75
TOKENS = 1_000_000  # that a task holds at once
PAIR_BITS, CHILD_BITS = 38, 26
END = int(mix(np.array([0x656E64], np.uint64))[0])  # the end token's key
_U = np.uint64
_open: dict[str, dict] = {}


def local_path(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model's files are memory-mapped: spark.checkpoint.dir must be a mounted folder, not {path}")
    return parts.path


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, in byte planes."""
    d = np.diff(keys, prepend=_U(0))
    planes = np.concatenate((d.view(np.uint8).reshape(-1, 8).T.ravel(), counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()))
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 16
    planes = np.ascontiguousarray(raw.reshape(16, n).T)
    keys = np.cumsum(np.ascontiguousarray(planes[:, :8]).view(np.uint64).ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(planes[:, 8:]).view(np.int64).ravel()


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    k = keys[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[at], np.add.reduceat(counts[order], at)


def merged(blobs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over sorted runs, taken one by one: what is held is the distinct keys so far, about twice."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for b in blobs:
        done.append(unpack(b))
        while len(done) > 1 and len(done[-2][0]) <= 2 * len(done[-1][0]):
            (k1, c1), (k2, c2) = done.pop(), done.pop()
            done.append(summed(np.concatenate((k1, k2)), np.concatenate((c1, c2))))
    if not done:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return summed(np.concatenate([k for k, _ in done]), np.concatenate([c for _, c in done]))


def token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Word keys with the end after each text, tokens of each text, and their ids."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    ids: list[pa.Array] = []
    have = 0
    for batch in chunks(batches, "_text"):
        data, offsets = bytes_of(batch.column("_text"))
        data = LOWER[data]
        starts, ends, n = words(data, offsets)
        keys.append(np.insert(span_hashes(data, starts, ends), np.cumsum(n), _U(END)))
        counts.append(n + 1)
        ids.append(batch.column("_id"))
        have += len(keys[-1])
        if have >= TOKENS:
            yield np.concatenate(keys), np.concatenate(counts), pa.concat_arrays(ids)
            keys, counts, ids, have = [], [], [], 0
    if have:
        yield np.concatenate(keys), np.concatenate(counts), pa.concat_arrays(ids)


def emit(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard of sorted keys; shards is sorted too."""
    if len(keys):
        at = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1])))
        to = np.append(at[1:], len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(shards[at].astype(np.int32)), pa.array([pack(keys[a:b], counts[a:b]) for a, b in zip(at, to, strict=True)], pa.binary())], ["shard", "blob"])


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's place among them; hashed, so that only the distinct ones are sorted."""
    codes, u = pd.factorize(values)
    order = np.argsort(u)
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], place[codes]


def distinct_pairs(a: np.ndarray, b: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows (a, b) of numbers below the bound, and each row's place among them: one sort of numbers that hold a, b and the
    row's own place, where 64 bits hold them."""
    bits, own = max(1, (bound - 1).bit_length()), max(1, (len(a) - 1).bit_length())
    if 2 * bits + own > 64:
        u, place = distinct(a.astype(np.uint64) << _U(32) | b.astype(np.uint64))
        return (u >> _U(32)).astype(np.int64), (u & _U(0xFFFFFFFF)).astype(np.int64), place
    key = a.astype(np.uint64) << _U(bits + own) | b.astype(np.uint64) << _U(own) | np.arange(len(a), dtype=np.uint64)
    key.sort()
    row = (key & _U((1 << own) - 1)).astype(np.int64)
    key >>= _U(own)
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    place = np.empty(len(key), np.int64)
    place[row] = np.cumsum(new) - 1
    u = key[new]
    return (u >> _U(bits)).astype(np.int64), (u & _U((1 << bits) - 1)).astype(np.int64), place


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and each one's place among them."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new], np.cumsum(new) - 1


def codebook(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 quantiles and each value's nearest one."""
    if not len(values):
        return np.zeros(256), np.zeros(0, np.uint8)
    book = np.quantile(values, (np.arange(256) + 0.5) / 256)
    at = np.clip(np.searchsorted(book, values), 1, 255)
    return book, (at - (np.abs(values - book[at - 1]) < np.abs(values - book[at]))).astype(np.uint8)


class Trie:
    """The mapped files. ``info`` holds the folder, the number of shards and, for each level, the first number in each shard."""

    def __init__(self, info: dict):
        self.info = info
        self.shards = info["shards"]
        self.cached: dict[tuple[str, int], dict] = _open.setdefault(info["folder"], {})
        self.n, self.v = info["tokens"], int(info["words"][-1]) if "words" in info else 0

    def file(self, level: str, shard: int) -> dict:
        if (level, shard) not in self.cached:
            a = read_arrays(f"{self.info['folder']}/{level}-{shard}")
            out = {k: x for k, x in a.items() if "." not in k}
            for name in {k.split(".")[0] for k in a if "." in k}:
                out[name] = EliasFano({k.split(".")[1]: x for k, x in a.items() if k.startswith(f"{name}.")})
            self.cached[level, shard] = out
        return self.cached[level, shard]

    def shard_of_key(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - self.shards.bit_length() + 1)).astype(np.int64) if self.shards > 1 else np.zeros(len(keys), np.int64)

    def by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Runs of equal shards in a sorted array."""
        if len(shard):
            at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            for a, b in zip(at, [*at[1:], len(shard)], strict=True):
                yield int(shard[a]), slice(a, b)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted word keys."""
        number, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        if "words" in self.info:
            for s, part in self.by_shard(self.shard_of_key(keys)):
                f = self.file("words", s)
                i = f["keys"].find(keys[part] & _U((1 << 64 - self.shards.bit_length() + 1) - 1))
                number[part] = np.where(i >= 0, i + self.info["words"][s], -1)
                if f["keys"].n:
                    count[part] = np.where(i >= 0, f["counts"][np.maximum(i, 0)], 0)
        return number, count

    def counts(self, number: np.ndarray) -> np.ndarray:
        """Counts of sorted word numbers."""
        out = np.zeros(len(number), np.int64)
        for s, part in self.by_shard(np.searchsorted(self.info["words"], number, "right") - 1):
            out[part] = self.file("words", s)["counts"][number[part] - self.info["words"][s]]
        return out

    def children(self, level: str, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Number, in its level, of each context's child, or -1; sorted by context. The child's value is searched among the level's values,
        shifted by the last value before its context."""
        base = self.info["words" if level == "pairs" else "spans"]
        out = np.full(len(context), -1, np.int64)
        for s, part in self.by_shard(np.searchsorted(base, context, "right") - 1):
            f = self.file(level, s)
            if not f["values"].n:
                continue
            own, where = runs(context[part] - base[s])
            begin, end = f["pointers"].access(own).astype(np.int64), f["pointers"].access(own + 1).astype(np.int64)
            shift = np.where(begin > 0, f["values"].access(np.maximum(begin - 1, 0)).astype(np.int64) + 1, 0)
            go = np.flatnonzero((end > begin)[where])
            at = where[go]
            x = shift[at] + child[part][go]
            i = f["values"].find(x)
            i = np.where((i >= begin[at]) & (i < end[at]), i, -1)
            got = out[part]
            got[go] = np.where(i >= 0, i + self.info[level][s], -1)
            out[part] = got
        return out

    def value(self, level: str, field: str, number: np.ndarray) -> np.ndarray:
        """A quantised field (log10) of sorted numbers; a field of level "triples" that belongs to pairs is numbered as they are."""
        base = self.info[{("pairs", "weight"): "words", ("pairs", "prob"): "pairs", ("triples", "weight"): "spans", ("triples", "prob"): "triples"}[level, field]]
        out = np.zeros(len(number))
        for s, part in self.by_shard(np.searchsorted(base, number, "right") - 1):
            f = self.file(level, s)
            out[part] = f[f"{field}_book"][f[field][number[part] - base[s]]]
        return out

    def second_word(self, pair: np.ndarray) -> np.ndarray:
        """Numbers of the second words of sorted pairs."""
        base = self.info["pairs"]
        out = np.zeros(len(pair), np.int64)
        for s, part in self.by_shard(np.searchsorted(base, pair, "right") - 1):
            f, own = self.file("pairs", s), pair[part] - base[s]
            pointers = f["pointers"].access(np.arange(f["pointers"].n)).astype(np.int64)
            begin = pointers[np.searchsorted(pointers, own, "right") - 1]
            shift = np.where(begin > 0, f["values"].access(np.maximum(begin - 1, 0)).astype(np.int64) + 1, 0)
            out[part] = f["values"].access(own).astype(np.int64) - shift
        return out

    def pair_counts(self, lo: int, hi: int) -> np.ndarray:
        """Counts of the pairs numbered from lo on, below hi."""
        base = self.info["pairs"]
        parts = [np.asarray(self.file("pairs", s)["counts"])[max(lo - base[s], 0) : max(hi - base[s], 0)] for s in range(self.shards) if base[s] < hi and base[s + 1] > lo]
        return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)

    def first_child(self, word: np.ndarray) -> np.ndarray:
        """Number of the first pair of sorted words."""
        base = self.info["words"]
        out = np.zeros(len(word), np.int64)
        for s, part in self.by_shard(np.searchsorted(base, word, "right") - 1):
            own, where = runs(word[part] - base[s])
            out[part] = self.file("pairs", s)["pointers"].access(own).astype(np.int64)[where] + self.info["pairs"][s]
        return out

    def sorted_call(self, f, *columns: np.ndarray) -> np.ndarray:
        """f over the distinct rows of the columns, sorted; its results in the rows' order."""
        if len(columns) == 1:
            u, where = distinct(columns[0])
            return f(u)[where]
        order = np.lexsort(columns[::-1])
        cols = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        if len(order):
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = f(*[c[new] for c in cols])[np.cumsum(new) - 1] if len(order) else 0
        return out


class Batch:
    """The tokens of some texts, looked up a distinct word, pair and triple at a time. Words of the batch go by their place among its distinct
    words, pairs by theirs among its distinct known pairs; both orders are those of the trie's numbers."""

    def __init__(self, trie: Trie, keys: np.ndarray, counts: np.ndarray):
        self.trie = trie
        self.last = np.zeros(len(keys), bool)
        self.last[np.cumsum(counts) - 1] = True
        u, self.word = distinct(keys)
        self.number, self.count = trie.lookup(u)
        self.known = self.number >= 0

    def pair_tokens(self) -> np.ndarray:
        """Tokens that follow a token of their text, both known."""
        known = self.known[self.word]
        return np.flatnonzero(known[1:] & known[:-1] & ~self.last[:-1]) + 1

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray]:
        t = self.pair_tokens()
        return summed(self.number[self.word[t - 1]].astype(np.uint64) << _U(32) | self.number[self.word[t]].astype(np.uint64))

    def find_pairs(self) -> None:
        """pair: for each token the place of its pair (the token before, itself), or -1; pair_number: these pairs' numbers."""
        t = self.pair_tokens()
        a, b, place = distinct_pairs(self.word[t - 1], self.word[t], len(self.number))
        found = self.trie.children("pairs", self.number[a], self.number[b])
        has = found >= 0
        self.pair = np.full(len(self.word), -1, np.int64)
        self.pair[t] = np.where(has, np.cumsum(has) - 1, -1)[place]
        self.pair_number, self.pair_context = found[has], self.number[a[has]]

    def find_triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens whose own and preceding pairs are known; their distinct triples as (number of the first pair, place of the second among the
        successors of its first word), and each token's place among these."""
        t = np.flatnonzero((self.pair[1:] >= 0) & (self.pair[:-1] >= 0)) + 1
        a, b, place = distinct_pairs(self.pair[t - 1], self.pair[t], len(self.pair_number))
        word, at = runs(self.pair_context)
        child = (self.pair_number - self.trie.first_child(word)[at])[b]
        if len(child) and child.max() >= 1 << CHILD_BITS:
            raise ValueError(f"a word with 2^{CHILD_BITS} kept successors or more")
        return t, self.pair_number[a], child, place

    def triple_keys(self) -> tuple[np.ndarray, np.ndarray]:
        self.find_pairs()
        _, first, child, place = self.find_triples()
        return first.astype(np.uint64) << _U(CHILD_BITS) | child.astype(np.uint64), np.bincount(place, minlength=len(first)).astype(np.int64)

    def log10(self) -> tuple[np.ndarray, np.ndarray]:
        """Base and smoothed log10 probability of each token."""
        trie = self.trie
        base = np.log10((self.count + 1) / (trie.n + trie.v + 1))[self.word]
        score = base.copy()
        if "pairs" not in trie.info or not len(score):
            return base, score
        weight = np.zeros(len(self.number))
        weight[self.known] = trie.value("pairs", "weight", self.number[self.known])
        t = np.flatnonzero(~self.last[:-1]) + 1
        score[t] += weight[self.word[t - 1]]
        self.find_pairs()
        p = np.flatnonzero(self.pair >= 0)
        score[p] = trie.value("pairs", "prob", self.pair_number)[self.pair[p]]
        if "triples" in trie.info:
            t = np.flatnonzero((self.pair[:-1] >= 0) & ~self.last[:-1]) + 1
            score[t] += trie.value("triples", "weight", self.pair_number)[self.pair[t - 1]]
            t, first, child, place = self.find_triples()
            triple = trie.children("triples", first, child)
            has = triple >= 0
            prob = np.zeros(len(triple))
            prob[has] = trie.value("triples", "prob", triple[has])
            hit = has[place]
            score[t[hit]] = prob[place[hit]]
        return base, score


def level_arrays(context: np.ndarray, child: np.ndarray, contexts: int) -> dict[str, np.ndarray]:
    """Pointers and shifted successor values of a shard's kept n-grams, sorted by local context and child."""
    n = len(context)
    many = np.bincount(context, minlength=contexts)
    to = np.cumsum(many)
    if n:
        lasts = to[many > 0] - 1
        rise = np.zeros(contexts, np.int64)
        rise[many > 0] = child[lasts] + 1
        shift = np.cumsum(rise) - rise
        values = shift[context] + child
        universe = int(values[-1]) + 1
    else:
        values, universe = np.zeros(0, np.int64), 1
    out = {f"pointers.{k}": a for k, a in encode(np.concatenate(([0], to)), n + 1).items()}
    return out | {f"values.{k}": a for k, a in encode(values, universe).items()}


def context_weights(context: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """What discounting leaves of each context, of its own total."""
    kept = np.bincount(context, counts - DISCOUNT, len(totals))
    return np.log10(np.maximum(1 - kept / np.maximum(totals, 1), 1e-9))


def _grouped(rows: DataFrame, write, spark: SparkSession) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None

        def blobs() -> Iterator[bytes]:
            nonlocal shard
            for b in batches:
                for row in range(b.num_rows):
                    shard = b.column("shard")[row].as_py()
                    yield b.column("blob")[row].as_py()

        keys, counts = merged(blobs())
        if shard is not None:
            n, total = write(shard, keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["shard", "n", "total"])

    return rows.groupBy("shard").applyInArrow(run, "shard int, n long, total long").collect()  # a row a shard


def _bases(got: list, shards: int) -> np.ndarray:
    n = np.zeros(shards, np.int64)
    for r in got:
        n[r["shard"]] = r["n"]
    return np.concatenate(([0], np.cumsum(n)))


def build(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> dict:
    """Counts and writes the levels; returns the small description that scored() needs."""
    spark = docs.sparkSession
    shards = 1 << max(4, (partitions(spark) - 1).bit_length())
    folder = local_path(new_path(spark, "lm"))
    info: dict = {"folder": folder, "shards": shards, "tokens": 0}
    texts = docs.filter(F.coalesce(fold(id_col, modulus), F.lit(-1)) != held).select(F.col(id_col).cast("string").alias("_id"), text_bytes(F.col(text_col).cast("string")).alias("_text"))

    def empty(level: str, contexts: np.ndarray, missing: set[int]) -> None:
        for s in missing:
            own = int(contexts[s + 1] - contexts[s]) if level != "words" else 0
            write_arrays(f"{folder}/{level}-{s}", {f"keys.{k}": a for k, a in encode(np.zeros(0, np.uint64), 1).items()} | {"counts": np.zeros(0, np.int64)} if level == "words" else level_arrays(np.zeros(0, np.int64), np.zeros(0, np.int64), own) | {"prob": np.zeros(0, np.uint8), "prob_book": np.zeros(256), "weight": np.zeros(own, np.uint8), "weight_book": np.zeros(256), "counts": np.zeros(0, np.int64)})

    bits = shards.bit_length() - 1

    def count_words(batches):
        for keys, _, _ in token_batches(batches):
            k, c = summed(keys)
            yield from emit((k >> _U(64 - bits)).astype(np.int64), k, c)

    def write_words(shard, keys, counts):
        base = _U(shard) << _U(64 - bits)
        arrays = {f"keys.{k}": a for k, a in encode(keys - base, 1 << (64 - bits)).items()}
        small = counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts
        write_arrays(f"{folder}/words-{shard}", arrays | {"counts": small})
        return len(keys), int(counts.sum())

    got = _grouped(texts.mapInArrow(count_words, "shard int, blob binary"), write_words, spark)
    info["words"] = _bases(got, shards)
    info["tokens"] = sum(r["total"] for r in got)
    if info["words"][-1] >= 1 << 32:
        raise ValueError("2^32 distinct words or more")
    empty("words", info["words"], set(range(shards)) - {r["shard"] for r in got})
    if order == 1 or not got:
        return info

    def count_pairs(batches, info=dict(info)):
        trie = Trie(info)
        for keys, n, _ in token_batches(batches):
            k, c = Batch(trie, keys, n).pair_keys()
            yield from emit(np.searchsorted(info["words"], (k >> _U(32)).astype(np.int64), "right") - 1, k, c)

    def write_pairs(shard, keys, counts, info=dict(info)):
        trie = Trie(info)
        base, own = info["words"][shard], int(info["words"][shard + 1] - info["words"][shard])
        context, child = (keys >> _U(32)).astype(np.int64) - base, (keys & _U(0xFFFFFFFF)).astype(np.int64)
        totals = np.asarray(trie.file("words", shard)["counts"]).astype(np.int64)
        weight = context_weights(context, counts, totals)
        u, where = distinct(child)
        p1 = (trie.counts(u)[where] + 1) / (trie.n + trie.v + 1)
        prob = np.log10((counts - DISCOUNT) / np.maximum(totals[context], 1) + 10 ** weight[context] * p1)
        pb, pq = codebook(prob)
        wb, wq = codebook(weight)
        wb[np.abs(wb) < 1e-12] = 0.0
        write_arrays(f"{folder}/pairs-{shard}", level_arrays(context, child, own) | {"prob": pq, "prob_book": pb, "weight": wq, "weight_book": wb, "counts": counts})
        return len(keys), int(counts.sum())

    got = _grouped(texts.mapInArrow(count_pairs, "shard int, blob binary"), write_pairs, spark)
    empty("pairs", info["words"], set(range(shards)) - {r["shard"] for r in got})
    info["pairs"] = _bases(got, shards)
    if order == 2:
        return info
    if info["pairs"][-1] >= 1 << PAIR_BITS:
        raise ValueError(f"2^{PAIR_BITS} pairs or more")

    # a triple's shard is its first pair's, in spans of equally many pairs: the triples of a common word fall into many
    info["spans"] = np.arange(shards + 1) * int(info["pairs"][-1]) // shards

    def count_triples(batches, info=dict(info)):
        trie = Trie(info)
        for keys, n, _ in token_batches(batches):
            k, c = Batch(trie, keys, n).triple_keys()
            yield from emit(np.searchsorted(info["spans"], (k >> _U(CHILD_BITS)).astype(np.int64), "right") - 1, k, c)

    def write_triples(shard, keys, counts, info=dict(info)):
        trie = Trie(info)
        base, own = info["spans"][shard], int(info["spans"][shard + 1] - info["spans"][shard])
        context, child = (keys >> _U(CHILD_BITS)).astype(np.int64) - base, (keys & _U((1 << CHILD_BITS) - 1)).astype(np.int64)
        totals = trie.pair_counts(int(base), int(base) + own)
        weight = context_weights(context, counts, totals)
        # the second word v of each context, and the pair (v, w) that the child stands for
        own_context, where = runs(context)
        lower = trie.sorted_call(trie.first_child, trie.second_word(own_context + base))[where] + child if len(context) else child
        u, where2 = distinct(lower)
        p2 = 10 ** trie.value("pairs", "prob", u)[where2]
        prob = np.log10((counts - DISCOUNT) / np.maximum(totals[context], 1) + 10 ** weight[context] * p2)
        pb, pq = codebook(prob)
        wb, wq = codebook(weight)
        wb[np.abs(wb) < 1e-12] = 0.0
        write_arrays(f"{folder}/triples-{shard}", level_arrays(context, child, own) | {"prob": pq, "prob_book": pb, "weight": wq, "weight_book": wb})
        return len(keys), int(counts.sum())

    got = _grouped(texts.mapInArrow(count_triples, "shard int, blob binary"), write_triples, spark)
    empty("triples", info["spans"], set(range(shards)) - {r["shard"] for r in got})
    info["triples"] = _bases(got, shards)
    return info


def scored(docs: DataFrame, info: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of the whole text and its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(info)
        for keys, n, ids in token_batches(batches):
            found = Batch(trie, keys, n)
            base, score = found.log10()
            known = (found.count > 0)[found.word].astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(per_doc(known, n)), pa.array(np.full(len(n), trie.n, np.int64)), pa.array(per_sum(base, n)), pa.array(per_sum(score, n))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    src = docs.select(F.col(id_col).alias("_id"), text_bytes(F.col(text_col).cast("string")).alias("_text"))
    return src.mapInArrow(run, f"doc_id {src.schema['_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def per_sum(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of each text's tokens (one at least)."""
    return np.add.reduceat(x, np.cumsum(n) - n)
