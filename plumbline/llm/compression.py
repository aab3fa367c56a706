"""Classifiers that compare compressed sizes under two zstandard dictionaries, one for each class.

Two ways to build the pair from labelled texts:

* ``plain``: each dictionary is a shuffled sample of its class's windows. What counts is how much shorter whole windows get.
* ``contrast``: both dictionaries begin with the same ordinary words, so that common text costs the same under either, and end with
  the word beginnings and words over-represented in their own class (a z-test on document counts, copies taken once). What counts is
  single windows that get shorter.

A text is cut into windows at spaces; the differences of their compressed lengths, normalised, become a few features of the text
(mean, extremes, sums, counts, and how many windows there are, as extremes and sums spread with these) and a logistic calibration, fitted on labelled texts that the dictionaries haven't seen, turns them
into a score. Training takes a bounded sample of labelled rows (``per_class`` texts a class, chosen by hash) and reads their whole texts:
the driver takes them one at a time and keeps counts, min-hashes and a bounded set of windows, the calibration's features are computed
on the executors. Every text is scored as a whole. Null is an empty text, which scores like a text without evidence. Rows with a null
label aren't used; an id that repeats in the labels counts once, with its greatest label, and equal rows of the documents once. With one
class only, or none, nothing can be told apart: the model isn't ``calibrated`` and every score is that class's share (one half without
rows).
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, stored, text_bytes

PER_CLASS = 4000
_STRIP = b".,;:!?*%&$#\"'()[]"
_made: dict[int, tuple] = {}


def windows(text: bytes, size: int) -> list[bytes]:
    out, i, n = [], 0, len(text)
    while i < n:
        j = min(n, i + size)
        if j < n and (k := text.rfind(b" ", i, j)) > i:
            j = k + 1
        out.append(text[i:j])
        i = j
    return out


class Distinct:
    """Tells texts that share one of four min-hashes of five-word shingles with an earlier one; holds four numbers a text."""

    FACTORS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def is_new(self, text: bytes) -> bool:
        w = text.lower().split()
        least = [(1 << 64) - 1] * 4
        for i in range(0, max(1, len(w) - 4), 1 << 16):
            h = np.array([xxhash.xxh3_64_intdigest(b" ".join(w[j : j + 5])) for j in range(i, min(i + (1 << 16), max(1, len(w) - 4)))], np.uint64)
            least = [min(x, int((h * np.uint64(f)).min())) for x, f in zip(least, self.FACTORS, strict=True)]
        keys = set(enumerate(least))
        new = not keys & self.seen
        if new:
            self.seen |= keys
        return new


def terms(text: bytes) -> set[bytes]:
    """Its words (between spaces) and its words' beginnings of four to eight bytes (after a space)."""
    out: set[bytes] = set()
    for w in {w.strip(_STRIP) for w in text.lower().split()}:
        out.add(b" " + w + b" ")
        out.update(b" " + w[:k] for k in range(4, min(8, len(w)) + 1))
    return out


def marked_terms(own: Counter, other: Counter, n: int, m: int, z_least: float, ratio: float) -> list[bytes]:
    """Terms over-represented in a class, rarest first: of terms that begin alike the shortest, extended while it stays as frequent."""
    found = []
    for t, c in own.items():
        p, q = c / n, other[t] / m
        both = (c + other[t] + 1) / (n + m + 2)
        if c >= 3 and p > q and (p - q) / math.sqrt(both * (1 - both) * (1 / n + 1 / m)) > z_least and (c + 0.5) / (n + 1) > ratio * (other[t] + 0.5) / (m + 1):
            found.append(t)
    heads: dict[bytes, bytes] = {}
    for t in sorted(found, key=lambda t: (len(t), t)):
        head = next((t[:k] for k in range(2, len(t)) if t[:k] in heads), None)
        if head is None:
            heads[t] = t
        elif own[t] >= 0.8 * own[head]:
            heads[head] = t
    return sorted(heads.values(), key=lambda t: (own[t], t))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(window_log=18, chain_log=15, hash_log=17, search_log=6, min_match=5, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)


class Model:
    """Two dictionaries and a calibration; small enough (under 1 MB) to travel in a closure."""

    def __init__(self, dictionaries: tuple[bytes, bytes], sizes: tuple[int, ...], lower: bool, contrast: bool):
        self.dictionaries, self.sizes, self.lower, self.contrast = dictionaries, sizes, lower, contrast
        self.mean = self.scale = self.weights = None
        self.constant = 0.5
        self.key = zlib.crc32(dictionaries[0]) << 32 | zlib.crc32(dictionaries[1])

    def features(self, text: bytes) -> list[float]:
        if self.key not in _made:
            if len(_made) > 8:
                _made.clear()
            _made[self.key] = tuple(_compressor(d) for d in self.dictionaries)
        zero, one = (c.compress for c in _made[self.key])
        t = text.lower() if self.lower else text
        out: list[float] = []
        for size in self.sizes:
            parts = windows(t, size)
            diff = [len(zero(p)) - len(one(p)) for p in parts]  # positive: shorter under the dictionary of class 1
            if self.contrast:
                top = sorted(diff)[-2:]
                mass = sum(d - 1 for d in diff if d > 1)
                out += [top[-1] if top else 0, top[0] if len(top) > 1 else 0, mass, math.log1p(mass), sum(d >= 3 for d in diff), sum(d < 0 for d in diff), math.log1p(len(diff))]
            else:
                n = max(1, len(t))
                shares = [d / len(p) for d, p in zip(diff, parts, strict=True)] or [0.0]
                total = sum(diff) / n
                out += [total, min(shares), max(shares), sum(d < 0 for d in diff) / len(shares), sum(d > 0 for d in diff) / len(shares), math.tanh(8 * total), math.log1p(len(diff))]
        return out

    @property
    def calibrated(self) -> bool:
        return self.weights is not None

    def calibrate(self, features: list[list[float]], labels: list[int], shares: tuple[int, int]) -> Model:
        """shares: how many training texts each class has."""
        y = np.array(labels, float)
        self.constant = (shares[1] + 0.5) / (sum(shares) + 1)
        if 0 < y.sum() < len(y):
            x = np.array(features)
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
            self.weights = logistic(np.c_[np.ones(len(x)), (x - self.mean) / self.scale], y)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), -1) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + np.clip(x, -50, 50) @ self.weights[1:], -700, 700)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by damped Newton steps; the constant isn't penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[0] = 1e-9

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        size = 1.0
        while size > 1e-6 and (then := loss(w - size * step)) > now:
            size /= 2
        w, gain, now = w - size * step, now - then, then
        if gain < 1e-9:
            break
    return w


class Windows:
    """The windows with the least hashes, at most so many."""

    def __init__(self, most: int):
        self.most = most
        self.heap: list[tuple[int, bytes]] = []
        self.have: set[bytes] = set()

    def add(self, parts: Iterable[bytes]) -> None:
        for p in parts:
            item = (-xxhash.xxh3_64_intdigest(p), p)
            if p in self.have or (len(self.heap) == self.most and item <= self.heap[0]):
                continue
            self.have.add(p)
            if len(self.heap) < self.most:
                heapq.heappush(self.heap, item)
            else:
                self.have.discard(heapq.heapreplace(self.heap, item)[1])

    def content(self, size: int) -> bytes:
        return b"".join(p for _, p in sorted(self.heap, reverse=True))[:size] or b"\0" * 64


def dictionaries(texts: Iterable[tuple[bytes, int]], *, kind: str, lower: bool, base_bytes: int, z_least: float, ratio: float) -> tuple[bytes, bytes]:
    """Both dictionaries from labelled texts, taken one at a time."""
    distinct = (Distinct(), Distinct())
    df, n = (Counter(), Counter()), [0, 0]
    kept = (Windows(1 + 2 * base_bytes // 512), Windows(1 + 2 * base_bytes // 512))
    for text, label in texts:
        if not distinct[label].is_new(text):
            continue
        n[label] += 1
        if kind == "contrast":
            df[label].update(terms(text))
        else:
            kept[label].add(windows(text.lower() if lower else text, 512))
    if kind != "contrast":
        return kept[0].content(2 * base_bytes), kept[1].content(2 * base_bytes)
    base, used = [], 0
    for t in (t for t, _ in sorted(df[0].items(), key=lambda x: (-x[1], x[0])) if t.endswith(b" ") and len(t) > 2):
        if used + len(t) > base_bytes:
            break
        base.append(t)
        used += len(t)
    start = b"".join(base[::-1]) or b"\0" * 64
    own = [b"".join(marked_terms(df[c], df[1 - c], max(1, n[c]), max(1, n[1 - c]), z_least, ratio))[-base_bytes:] for c in (0, 1)]
    return start + own[0], start + own[1]


def train(rows: DataFrame, *, kind: str, sizes: tuple[int, ...], lower: bool, base_bytes: int = 32_768, z_least: float = 6.0, ratio: float = 8.0) -> Model:
    """Dictionaries from two thirds of the sampled rows (by the text's hash), calibration on the rest."""
    rows = stored(rows, "sample", per_core=1)
    rest = F.pmod("_h", F.lit(3)) == 0
    build = rows.filter(~rest).orderBy("_h", "_y", "_id").select("_t", "_y").toLocalIterator()
    model = Model(dictionaries(((bytes(r["_t"]), r["_y"]) for r in build), kind=kind, lower=lower, base_bytes=base_bytes, z_least=z_least, ratio=ratio), sizes, lower, kind == "contrast")

    @F.arrow_udf("array<double>")
    def features(text: pa.Array) -> pa.Array:
        return pa.array([model.features(t.as_py()) for t in text], pa.list_(pa.float64()))

    got = sorted((list(r["_f"]), r["_y"]) for r in rows.filter(rest).select("_y", features("_t").alias("_f")).collect())  # under 2 x per_class short rows
    many = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    discard(rows)
    return model.calibrate([f for f, _ in got], [y for _, y in got], (many.get(0, 0), many.get(1, 0)))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held: int, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """_id, _y, _h, _t: at most per_class distinct labelled rows of each class, with their whole texts, of ids whose crc32 modulo ``modulus``
    isn't ``held``. First the ids and hashes are chosen, so that no text but theirs moves."""
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold("_id", modulus) != held))
    lab = lab.groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = [lab.filter(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # 2 x per_class rows
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(few, "_id").select("_id", "_y", F.xxhash64("_text").alias("_h"), "_text")
    keys = texts.select("_id", "_y", "_h").distinct()  # more rows than ids only where an id has several texts
    keys = [keys.filter(F.col("_y") == c).orderBy(F.xxhash64("_id", "_h"), "_id", "_h").limit(per_class) for c in (0, 1)]
    return texts.join(F.broadcast(keys[0].unionByName(keys[1])), ["_id", "_y", "_h"]).groupBy("_id", "_y", "_h").agg(F.min(F.col("_text").cast("binary")).alias("_t"))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, of each whole text."""
    return docs.select(F.col(id_col).alias("doc_id"), score_of(model, text_col).alias("score"))


def score_of(model: Model, text_col: str = "text") -> Column:
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score([t.as_py() or b"" for t in text]))

    return score(text_bytes(F.col(text_col).cast("string")))

