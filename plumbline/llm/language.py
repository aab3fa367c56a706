"""Language identification as a mixture: each document's language proportions by expectation-maximisation over n-gram likelihoods.

Training counts byte trigrams (letters in context, lower-cased, hashed to 2^16 buckets) of the whole texts of a sample of labelled
documents, about ``per_language`` of each language; the counts give smoothed log-likelihoods for each language. The sample is a range of
hashes of id and text, of a width that each language's count gives, so no task gathers a language. A document is cut into units of ``UNIT`` bytes, each in one language; EM estimates the proportions, starting from all languages, and
languages are then taken out, least first, as long as the penalised likelihood (half a log of the units for each language) doesn't fall.
The prediction is the language with the largest proportion, the score its proportion.

Null text, and text without a letter, is ``und`` with score 0; so is everything if no language was learnt. Ids may repeat or be null.
Every text is read whole. Rows with a null language aren't learnt from; equal rows are learnt from once. A model holds a quarter of a
megabyte a language; more than ``MAX_LANGUAGES`` are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, fold, text_bytes

PER_LANGUAGE, MAX_LANGUAGES = 1000, 1000
UNIT, BUCKETS, SMOOTH = 24, 1 << 16, 0.5
_FOLD = np.full(256, 32, np.uint8)  # what isn't a letter separates
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of the concatenated texts, one for each byte (BUCKETS where the middle isn't a letter), and the text of each."""
    n, lens = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), lens)
    padded = np.full(len(data) + n + 2, 32, np.uint8)
    at = np.arange(len(data)) + doc + 1
    padded[at] = _FOLD[data]
    capital = (padded[1:] >= 0x80) & (padded[1:] <= 0x9E) & (padded[:-1] == 0xC3) & (padded[1:] != 0x97)  # capital letters of Latin-1
    padded[1:][capital] += 0x20
    p = padded.astype(np.uint32)
    code = ((p[at - 1] << 16 | p[at] << 8 | p[at + 1]) * np.uint32(2654435761)) >> np.uint32(16)
    return np.where(padded[at] != 32, code, BUCKETS).astype(np.int64), doc


def sample_counts(docs: DataFrame, modulus: int, held: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram counts (languages x buckets)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), text_bytes(F.col(text_col).cast("string")).alias("_text"))
    rows = rows.filter(F.col("_lang").isNotNull() & (F.coalesce(fold("_id", modulus), F.lit(-1)) != held))
    many = rows.groupBy("_lang").count().orderBy("_lang").limit(MAX_LANGUAGES + 1).collect()
    if len(many) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["_lang"] for r in many]
    number = {x: i for i, x in enumerate(languages)}
    scale = 1 << 53
    width = [F.struct(F.lit(r["_lang"]).alias("_lang"), F.lit(min(scale, per_language * scale // r["count"])).alias("_width")) for r in many]
    widths = docs.sparkSession.range(1).select(F.inline(F.array(*width))) if width else rows.select("_lang", F.lit(0).cast("long").alias("_width")).limit(0)
    few = rows.join(F.broadcast(widths), "_lang").withColumn("_h", F.xxhash64("_id", "_text")).filter(F.pmod("_h", F.lit(scale)) < F.col("_width"))
    texts = few.groupBy("_lang", "_h").agg(F.min("_text").alias("_text"))  # equal rows once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in chunks(batches, "_text", 1 << 20):
            code, doc = grams(*bytes_of(batch.column("_text")))
            lang = np.array([number[x] for x in batch.column("_lang").to_pylist()])[doc]
            for k in np.unique(lang):
                total[int(k)] = total.get(int(k), 0) + np.bincount(code[lang == k], minlength=BUCKETS + 1)[:BUCKETS]
        for k, c in total.items():
            b = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k, np.int32)), pa.array(b.astype(np.int32)), pa.array(c[b].astype(np.int64))], ["lang", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS), np.int64)
    sums = texts.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[sums["lang"], sums["bucket"]] = sums["n"]
    return languages, counts


class Model:
    """Log-likelihoods (a row for each language, and a zero for what isn't a letter) and the languages' priors."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        used = max(1, int((counts.sum(0) > 0).sum()))
        ll = np.log((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * used))
        ll -= ll.max(0, initial=-np.inf) if len(ll) else 0  # only differences between languages matter
        self.ll = np.c_[ll, np.zeros(len(languages))].astype(np.float32) / 3  # three trigrams share each letter
        self.prior = (counts.sum(1) + 1.0) / (counts.sum() + len(languages)) if languages else np.zeros(0)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of the units (units x languages) and the units of each text."""
        lens = np.diff(offsets)
        per = -(-lens // UNIT)
        code, _ = grams(data, offsets)
        first = np.repeat(offsets[:-1] - UNIT * (np.cumsum(per) - per), per) + UNIT * np.arange(per.sum())
        out = np.empty((len(first), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.ll[k][code], first) if len(first) else 0
        return out, per

    def em(self, like: np.ndarray, shift: np.ndarray, per: np.ndarray, share: np.ndarray, active: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (texts x languages) and log-likelihoods; like: the units' likelihoods, scaled by exp(shift)."""
        doc = np.repeat(np.arange(len(per)), per)
        begins = (np.cumsum(per) - per)[per > 0]
        pseudo = active * self.prior
        share = np.where(active, share, 0)
        share = share / np.maximum(share.sum(1, keepdims=True), 1e-300)
        total = np.zeros(len(per))
        for _ in range(steps):
            joint = like * share[doc]
            mass = np.maximum(joint.sum(1, keepdims=True), 1e-300)
            got = pseudo.copy()
            if len(begins):
                got[per > 0] += np.add.reduceat(joint / mass, begins)
                total[per > 0] = np.add.reduceat(np.log(mass[:, 0]) + shift, begins)
            share = got / np.maximum(got.sum(1, keepdims=True), 1e-300)
        return share, total

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the selected languages, and which are selected."""
        ll, per = self.units(data, offsets)
        shift = ll.max(1) if len(ll) else np.zeros(0)
        like = np.exp(ll - shift[:, None])
        n, k = len(per), len(self.languages)
        active = np.ones((n, k), bool)
        share, best = self.em(like, shift, per, np.tile(self.prior, (n, 1)), active, 8)
        fine = 0.5 * np.log(np.maximum(per, 2))
        open_ = np.ones(n, bool)
        first = True
        while open_.any():
            at = np.flatnonzero(open_ & (active.sum(1) > 1))
            if not len(at):
                break
            trial = active[at].copy()
            if first:  # all at once those with less than half a unit
                trial &= share[at] * per[at, None] >= 0.5
                trial[np.arange(len(at)), share[at].argmax(1)] = True
            else:
                least = np.where(trial, share[at], np.inf).argmin(1)
                trial[np.arange(len(at)), least] = False
            rows = np.repeat(np.isin(np.arange(n), at), per)
            s, total = self.em(like[rows], shift[rows], per[at], share[at], trial, 5)
            gain = total - best[at] + fine[at] * (active[at].sum(1) - trial.sum(1))
            take = gain >= 0
            share[at[take]], best[at[take]], active[at[take]] = s[take], total[take], trial[take]
            if not first:
                open_[at[~take]] = False
            first = False
            open_[active.sum(1) <= 1] = False
        return share, active


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages (those selected, with their proportions, largest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in chunks(batches, "_text", 1 << 20):
            data, offsets = bytes_of(batch.column("_text"))
            ascii_letters = np.concatenate(([0], np.cumsum(_LETTER[data])))[offsets]
            known = np.diff(ascii_letters) > 0
            for i in np.flatnonzero(~known & (np.diff(offsets) > 0)):
                known[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
            if not model.languages:
                known[:] = False
                share, active = np.zeros((batch.num_rows, 0)), np.zeros((batch.num_rows, 0), bool)
                top, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            else:
                share, active = model.predict(data, offsets)
                top = share.argmax(1)
                score = np.clip(share[np.arange(len(top)), top], 0, 1)
            pred = names[np.where(known, top, len(names) - 1)]
            sets = [[{"lang": names[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if a[k]] if ok else [] for s, a, ok in zip(share, active, known, strict=True)]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred.tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "languages"])

    src = docs.select(F.col(id_col).alias("doc_id"), text_bytes(F.col(text_col).cast("string")).alias("_text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, **columns) -> Model:
    return Model(*sample_counts(docs, modulus, held, **columns))
