"""Elias-Fano sequences in numpy: access, and search by value, for many queries at once; the arrays may be memory-mapped.

A monotone sequence is stored as the low bits of each value, packed, and the high bits in unary: value i sets bit (high + i). Samples of
the bits set before each word give select by binary search.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_U = np.uint64
_BITS = np.arange(256, dtype=np.uint8)[:, None] >> np.arange(8, dtype=np.uint8) & 1
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
_PLACE = np.zeros((256, 8), np.int64)  # place of the k-th bit set in a byte
for _b in range(256):
    _at = np.flatnonzero(_BITS[_b])
    _PLACE[_b, : len(_at)] = _at


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of values below ``universe`` (at most 2^64)."""
    n = len(values)
    low = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    low = min(low, 63)
    v = values.astype(np.uint64)
    high = (v >> _U(low)).astype(np.int64)
    bits = n + ((universe - 1) >> low if universe else 0) + 2
    words = np.zeros(bits // 64 + 1, np.uint64)
    at = high + np.arange(n)
    _or_into(words, at >> 6, _U(1) << (at & 63).astype(np.uint64))
    packed = np.zeros(n * low // 64 + 2, np.uint64)
    if low and n:
        rest = v & _U((1 << low) - 1)
        pos = np.arange(n, dtype=np.int64) * low
        shift = (pos & 63).astype(np.uint64)
        _or_into(packed, pos >> 6, rest << shift)
        over = (64 - shift.astype(np.int64)) < low
        _or_into(packed, (pos >> 6)[over] + 1, rest[over] >> (_U(64) - shift[over]))
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
    return {"head": np.array([n, low], np.int64), "high": words, "ones": ones, "zeros": 64 * np.arange(len(ones)) - ones, "low": packed}


def _or_into(out: np.ndarray, index: np.ndarray, bits: np.ndarray) -> None:
    """out[index] |= bits for a non-decreasing index."""
    if len(index):
        begins = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        out[index[begins]] |= np.bitwise_or.reduceat(bits, begins)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["head"])
        self.high, self.ones, self.zeros, self.low = arrays["high"], arrays["ones"], arrays["zeros"], arrays["low"]

    def _in_word(self, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th bit set in each word: the bytes' running counts by a multiplication, compared with k in one subtraction."""
        c = words - (words >> _U(1) & _U(0x5555555555555555))
        c = (c & _U(0x3333333333333333)) + (c >> _U(2) & _U(0x3333333333333333))
        c = (c + (c >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
        k = k.astype(np.uint64)
        place = np.bitwise_count((k * _ONES | _TOPS) - c & _TOPS).astype(np.uint64) << _U(3)
        before = (c << _U(8)) >> place & _U(255)
        return place.astype(np.int64) + _PLACE[words >> place & _U(255), k - before]

    def select1(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, "right") - 1
        return word * 64 + self._in_word(self.high[word], k - self.ones[word])

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + self._in_word(~self.high[word], k - self.zeros[word])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        pos = i * self.bits
        word = pos >> 6
        shift = (pos & 63).view(np.uint64)
        low = self.low[word] >> shift
        word += 1
        low |= self.low[word] << _U(1) << (_U(63) - shift)  # nothing of it where the shift is zero
        low &= _U((1 << self.bits) - 1)
        return low

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self.select1(i) - i).astype(np.uint64) << _U(self.bits) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the value (of repeated values the first), or -1: successor search from where its high bits' run begins. Runs hold two
        elements on average; where they are long (values that crowd), a binary search goes first."""
        x = x.astype(np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        h = (x >> _U(self.bits)).astype(np.int64)
        far = h >= int(self.zeros[-1]) - 1
        h[far] = 0
        place = np.zeros(len(x), np.int64)  # where the run of elements with these high bits begins
        later = np.flatnonzero(h)
        place[later] = self.select0(h[later] - 1) + 1
        want = x & _U((1 << self.bits) - 1)
        out = np.full(len(x), -1, np.int64)
        go = np.flatnonzero(~far) if far.any() else np.arange(len(x))
        place, at, want, h = place[go], (place - h)[go], want[go], h[go]
        step = 0
        while len(go):
            inside = (self.high[place >> 6] >> (place & 63).view(np.uint64) & _U(1)).astype(bool)
            have = self.lows(np.where(inside, at, 0))
            hit = np.flatnonzero(inside & (have == want))
            out[go[hit]] = at[hit]
            on = np.flatnonzero(inside & (have < want))
            go, place, at, want, h = go[on], place[on] + 1, at[on] + 1, want[on], h[on]
            step += 1
            if step == 8 and len(go):
                end = self.select0(h) - h
                lo, hi = at, end.copy()
                while (open_ := np.flatnonzero(lo < hi)).size:
                    mid = lo[open_] + hi[open_] >> 1
                    less = self.lows(mid) < want[open_]
                    lo[open_] = np.where(less, mid + 1, lo[open_])
                    hi[open_] = np.where(less, hi[open_], mid)
                ok = lo < end
                ok[ok] = self.lows(lo[ok]) == want[ok]
                out[go[ok]] = lo[ok]
                break
        return out


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file that np.memmap can read; written beside and renamed, so that a task that runs twice leaves one whole file."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(8 + len(text)) // 64) * 64
    os.makedirs(os.path.dirname(path), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        f.write(b"\0" * (start - 8 - len(text)))
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 64))
    os.replace(beside, path)


def read_arrays(path: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    start = -(-(8 + n) // 64) * 64
    out = {}
    for k, (kind, length, at) in head.items():
        d = np.dtype(kind)
        out[k] = np.asarray(raw[start + at : start + at + length * d.itemsize]).view(d)
    return out
