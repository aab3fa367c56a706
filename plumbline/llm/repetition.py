"""Repetition coverage: how much of a text lies inside n-grams and lines that it repeats.

Word hashes come from one prefix sum over the bytes, n-gram hashes by rolling them; a sort of a chunk's hashes, each mixed with its
document, shows the repeats. For each n the covered words are the union of the windows that repeat an earlier one; their share of
the text's characters is held against a limit, as are repeated lines.

Null is a text without words. Every row gives a row; ids may repeat or be null. An empty table gives an empty result. A text beyond CHUNK bytes is
measured alone, in pieces: beside the text a task holds about 14 bytes a word and 12 a line (for a moment twice the lines').
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, IS_NEWLINE, bytes_of, chunks, mix, per_doc, span_hashes, text_bytes, text_pieces, words

#: The largest share of characters inside repeated n-grams, by n, and of lines and their characters inside repeated lines.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ROLL = np.uint64(0x9FB21C651E98DF25)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key occurs twice or more, and whether it occurred before."""
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        s = keys[order]
        same = s[1:] == s[:-1]
        if same.any():
            member = np.zeros(len(keys), bool)
            member[1:] |= same
            member[:-1] |= same
            at = np.flatnonzero(member)
            idx = order[at]
            begins = np.flatnonzero(np.concatenate(([True], s[at][1:] != s[at][:-1])))
            again[idx] = later[idx] = True
            later[np.minimum.reduceat(idx, begins)] = False
    return again, later


def covered(windows: np.ndarray, k: int, n: int) -> np.ndarray:
    """Words inside the marked windows; windows holds the first word of each."""
    d = np.zeros(n + 1, np.int32)
    d[windows] += 1
    d[windows + k] -= 1  # windows of one length begin, and so end, at different words
    return np.cumsum(d[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], base_n: int = 8) -> dict[str, np.ndarray]:
    """Counts for each of the concatenated texts; dup_chars has a column for each n-gram length."""
    starts, ends, n_words = words(data, offsets)
    n_docs, n = len(n_words), len(starts)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    out = {"n_words": n_words, "word_chars": per_doc(chars, n_words)}
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    ls, le, n_lines = words(data, offsets, IS_NEWLINE)
    solid = np.searchsorted(starts, le) > np.searchsorted(starts, ls)  # has a word
    doc = np.repeat(np.arange(n_docs), n_lines)[solid]
    ls, le = ls[solid], le[solid]
    lines = np.bincount(doc, minlength=n_docs)
    salt = mix(np.arange(1, n_docs + 1).astype(np.uint64))
    _, later = repeats(mix(span_hashes(data, ls, le) ^ salt[doc]))
    out["n_lines"], out["n_dup_lines"] = lines, np.bincount(doc, later, n_docs).astype(np.int64)
    line_chars = points[le] - points[ls]
    out["line_chars"], out["dup_line_chars"] = np.bincount(doc, line_chars, n_docs), np.bincount(doc, line_chars * later, n_docs)

    h = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n_docs), n_words)
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(n)  # words from here to the text's end
    roll, dup = h.copy(), []
    out["n_repeat_words"] = np.zeros(n_docs, np.int64)
    for k in range(2, max((*lengths, base_n)) + 1):
        if n < k:
            dup += [np.zeros(n_docs, np.int64)] * (k in lengths)
            continue
        roll = roll[: n - k + 1] * _ROLL + h[k - 1 :]
        if k in lengths or k == base_n:
            at = np.flatnonzero(left[: n - k + 1] >= k)
            again, later = repeats(mix(roll[at] ^ salt[doc[at]]))
            if k == base_n:
                out["n_repeat_words"] = per_doc(covered(at[again], k, n), n_words)
            if k in lengths:
                dup.append(per_doc(np.where(covered(at[later], k, n), chars, 0), n_words))
    out["dup_chars"] = np.stack(dup, 1) if dup else np.zeros((n_docs, 0), np.int64)
    return out


#: Windows of a long text whose hashes are sorted at once.
SORTED = 4 << 20


def measure_long(data: np.ndarray, lengths: tuple[int, ...], base_n: int = 8, piece: int = CHUNK, most: int = SORTED) -> dict[str, np.ndarray]:
    """As measure(), of one text of any length: read in pieces, word and line hashes kept (12 bytes each), window hashes made anew by spans and compared
    in as many parts of the hash range as keep a sort under ``most``."""
    hashes, chars, symbols = [], [], 0
    for part in text_pieces(data, piece):
        starts, ends, _ = words(part, np.array([0, len(part)]))
        points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        hashes.append(span_hashes(part, starts, ends))
        chars.append((points[ends] - points[starts]).astype(np.uint32))
        symbols += int(_SYMBOL[part].sum())
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    hashes.clear()
    chars = np.concatenate(chars) if chars else np.zeros(0, np.uint32)
    line_hashes, line_chars = [], []
    for part in text_pieces(data, piece, IS_NEWLINE):
        starts, _, _ = words(part, np.array([0, len(part)]))
        ls, le, _ = words(part, np.array([0, len(part)]), IS_NEWLINE)
        solid = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        line_hashes.append(span_hashes(part, ls[solid], le[solid]))
        line_chars.append((points[le[solid]] - points[ls[solid]]).astype(np.uint32))
    lines = np.concatenate(line_hashes) if line_hashes else np.zeros(0, np.uint64)
    line_hashes.clear()
    line_chars = np.concatenate(line_chars) if line_chars else np.zeros(0, np.uint32)

    def marks(values: np.ndarray, k: int, which: int) -> np.ndarray:
        """Windows of k values that occur again anywhere (which 0), or occurred before (1)."""
        n = max(0, len(values) - k + 1)
        out, parts = np.zeros(n, bool), -(-n // most)
        for p in range(parts):
            keys, places = [], []
            for a in range(0, n, most):
                z = min(n, a + most)
                roll = values[a:z].copy()
                for j in range(1, k):
                    roll *= _ROLL
                    roll += values[a + j : z + j]
                roll = mix(roll)
                at = np.flatnonzero((roll >> np.uint64(20)) % np.uint64(parts) == p) if parts > 1 else np.arange(z - a)
                keys.append(roll[at])
                places.append(at + a)
            out[np.concatenate(places)[repeats(np.concatenate(keys))[which]]] = True
        return out

    def inside(k: int, which: int, weights: np.ndarray | None) -> int:
        """Words (or their weights) inside the marked windows."""
        found, total = marks(h, k, which), 0
        for a in range(0, len(h), most):
            z, first = min(len(h), a + most), max(0, a - k + 1)
            at = np.flatnonzero(found[first:z])
            hit = covered(at, k, z - first + k)[a - first : z - first]
            total += int(hit.sum() if weights is None else weights[a:z][hit].sum(dtype=np.int64))
        return total

    later = marks(lines, 1, 1)
    one = lambda x: np.array([int(x)], np.int64)
    return {
        "n_words": one(len(h)), "word_chars": one(chars.sum(dtype=np.int64)), "n_symbols": one(symbols), "n_lines": one(len(lines)), "n_dup_lines": one(later.sum()), "line_chars": one(line_chars.sum(dtype=np.int64)),
        "dup_line_chars": one(line_chars[later].sum(dtype=np.int64)), "n_repeat_words": one(inside(base_n, 0, None)), "dup_chars": np.array([[inside(k, 1, chars) for k in lengths]], np.int64).reshape(1, -1),
    }


def verdicts(m: dict[str, np.ndarray], limits: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)"""
    base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    most = np.array([limits[k] for k in sorted(limits)])
    ngrams = (m["dup_chars"] > most * m["word_chars"][:, None]).any(1)
    lines = (m["n_dup_lines"] > LINE_LIMIT * m["n_lines"]) | (m["dup_line_chars"] > LINE_CHAR_LIMIT * m["line_chars"])
    return base, ~(base | ngrams | lines)


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limits: dict[int, float] = NGRAM_LIMITS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_char_shares (by n-gram length), dup_line_char_share."""
    lengths = tuple(sorted(limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            data, offsets = bytes_of(batch.column("_text"))
            m = measure_long(data, lengths) if len(data) > CHUNK else measure(data, offsets, lengths)  # only a single text is longer
            base, kept = verdicts(m, limits)
            shares = m["dup_chars"] / np.maximum(m["word_chars"], 1)[:, None]
            longs = [pa.array(m[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, max(1, len(lengths)), np.int32)), pa.array(shares.ravel()))
            line = pa.array(m["dup_line_chars"] / np.maximum(m["line_chars"], 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(base), pa.array(kept), lists, line], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_char_shares", "dup_line_char_share"])

    src = docs.select(F.col(id_col).alias("doc_id"), text_bytes(F.col(text_col).cast("string")).alias("_text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_char_shares array<double>, dup_line_char_share double")
