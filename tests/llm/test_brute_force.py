"""Classifiers, mixtures and the pipeline again in plain Python, document by document."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import compression, language, quality, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").cache()


def trigrams(text: bytes) -> list[int | None]:
    """A bucket for each byte, None where it is no letter."""
    b = [32, *text, 32]
    folded = []
    for i, x in enumerate(b):
        if 65 <= x <= 90:
            x += 32
        elif not (97 <= x <= 122 or x >= 128):
            x = 32
        if i and 0x80 <= x <= 0x9E and x != 0x97 and b[i - 1] == 0xC3:
            x += 0x20
        folded.append(x)
    return [None if c == 32 else (((a << 16 | c << 8 | d) * 2654435761) % (1 << 32)) >> 16 for a, c, d in zip(folded, folded[1:], folded[2:], strict=False)]


def mixture(units: list[list[float]], prior: list[float]) -> tuple[list[float], list[bool]]:
    """Proportions and the selected languages of one document."""
    k = len(prior)

    def em(share, active, steps):
        share = [s if a else 0.0 for s, a in zip(share, active, strict=True)]
        share, total = [s / sum(share) for s in share], 0.0
        for _ in range(steps):
            got, total = [p if a else 0.0 for p, a in zip(prior, active, strict=True)], 0.0
            for u in units:
                top = max(u)
                joint = [math.exp(x - top) * s for x, s in zip(u, share, strict=True)]
                total += math.log(sum(joint)) + top
                got = [g + j / sum(joint) for g, j in zip(got, joint, strict=True)]
            share = [g / sum(got) for g in got]
        return share, total

    n, active = len(units), [True] * k
    fine = 0.5 * math.log(max(n, 2))
    share, best = em(prior, active, 8)
    first = True
    while sum(active) > 1:
        if first:  # all at once those with less than half a unit
            trial = [s * n >= 0.5 for s in share]
            trial[share.index(max(share))] = True
        else:
            trial = list(active)
            trial[min((x, i) for i, x in enumerate(share) if active[i])[1]] = False
        s, total = em(share, trial, 5)
        if total - best + fine * (sum(active) - sum(trial)) >= 0:
            share, best, active = s, total, trial
        elif not first:
            break
        first = False
    return share, active


def test_language_mixtures(spark, docs):
    rows = [r for r in docs.collect() if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    counts = collections.defaultdict(collections.Counter)
    for text, lang in {(r.text, r.lang) for r in rows}:
        counts[lang].update(g for g in trigrams(text.encode()) if g is not None)
    names = sorted(counts)
    model = language.fit(docs, modulus=4, held=2, per_language=10**6)
    assert model.languages == names
    used = len(set().union(*counts.values()))
    total = {k: sum(c.values()) for k, c in counts.items()}
    prior = [(total[k] + 1) / (sum(total.values()) + len(names)) for k in names]

    def likelihoods(text: bytes) -> list[list[float]]:
        grams, out = trigrams(text), []
        for i in range(0, len(text), language.UNIT):
            unit = [0.0] * len(names)
            for g in grams[i : i + language.UNIT]:
                if g is not None:
                    ll = [math.log((counts[k][g] + language.SMOOTH) / (total[k] + language.SMOOTH * used)) for k in names]
                    unit = [u + (x - max(ll)) / 3 for u, x in zip(unit, ll, strict=True)]
            out.append(unit)
        return out

    by_lang = {r.lang: r.text for r in rows}
    a, b = names[0], names[-1]
    texts = [r.text[:1500] for r in rows[:8]] + [by_lang[a][:600] + by_lang[b][:300], by_lang[a][:200] + by_lang[b][:900], "Ça va", "x"]
    got = language.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        share, active = mixture(likelihoods(text.encode()), prior)
        assert r.lang_pred == names[share.index(max(share))]
        assert abs(r.score - max(share)) < 2e-3
        assert {x.lang for x in r.languages} == {k for k, on in zip(names, active, strict=True) if on}


def plain_windows(text: bytes, size: int) -> list[bytes]:
    out = []
    while text:
        cut = size
        if len(text) > size:
            space = text[:size].rfind(b" ")
            cut = space + 1 if space > 0 else size
        out.append(text[:cut])
        text = text[cut:]
    return out


@pytest.mark.parametrize("maker,label,modulus,held", [(quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_compression_scores(spark, docs, labels, maker, label, modulus, held):
    model = maker.fit(docs, labels, modulus=modulus, held=held)
    parameters = {"window_log": 18, "chain_log": 15, "hash_log": 17, "search_log": 6, "min_match": 5, "target_length": 1, "strategy": zstandard.STRATEGY_FAST, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
    zero, one = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters(**parameters)) for d in model.dictionaries)

    def features(text: bytes) -> list[float]:
        text, out = text.lower() if model.lower else text, []
        for size in model.sizes:
            pairs = [(len(zero.compress(w)) - len(one.compress(w)), len(w)) for w in plain_windows(text, size)]
            d = sorted(x for x, _ in pairs)
            if model.contrast:
                mass = sum(max(0, x - 1) for x in d)
                out += [d[-1] if d else 0, d[-2] if len(d) > 1 else 0, mass, math.log(1 + mass), sum(x > 2 for x in d), sum(x < 0 for x in d), math.log(1 + len(d))]
            else:
                rel = [x / n for x, n in pairs] or [0.0]
                whole = sum(d) / max(1, len(text))
                out += [whole, min(rel), max(rel), sum(x < 0 for x in d) / len(rel), sum(x > 0 for x in d) / len(rel), math.tanh(8 * whole), math.log(1 + len(d))]
        return out

    texts = [r.text for r in docs.limit(10).collect()] + ["", None, "idiot " * 50, "a" * 3000]
    got = compression.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        x = [min(50, max(-50, (f - m) / s)) for f, m, s in zip(features((text or "").encode()), model.mean, model.scale, strict=True)]
        z = model.weights[0] + sum(a * b for a, b in zip(x, model.weights[1:], strict=True))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
    # the calibration is the optimum: on the third of the sample that it learnt from, the penalised loss has no slope
    rows = compression.sample(docs, labels, label, modulus, held).collect()
    kept = [r for r in rows if r["_h"] % 3 == 0]
    x = np.array([[1.0, *[(f - m) / s for f, m, s in zip(features(bytes(r["_t"])), model.mean, model.scale, strict=True)]] for r in kept])
    y = np.array([r["_y"] for r in kept])
    assert all(zlib.crc32(str(r["_id"]).encode()) % modulus != held for r in rows) and 0 < y.sum() < len(y)
    slope = x.T @ (1 / (1 + np.exp(-x @ model.weights)) - y)
    slope[1:] += 0.05 * model.weights[1:]
    assert np.abs(slope).max() < 1e-3


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_the_pipeline_stage_by_stage(spark, sf, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    clean = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    # common lines go
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    where = collections.defaultdict(set)
    for i in clean:
        for line in rows[i].text.split("\n"):
            where[key(line)].add(i)
    text = {i: "\n".join(x for x in rows[i].text.split("\n") if not key(x) or len(where[key(x)]) < 10) for i in clean}
    # one of each group of near copies stays
    prints = {i: fingerprint(t) for i, t in text.items()}
    kept: dict[int, int] = {}
    for i in sorted(text):
        group, todo = {i}, [i]
        while todo:
            x = todo.pop()
            near = {j for j in text if j not in group and (prints[x] ^ prints[j]).bit_count() <= 2}
            group |= near
            todo += near
        kept[i] = min(group)
    text = {i: t for i, t in text.items() if kept[i] == i}
    # sources take turns: earliest deadline first
    by_source = collections.defaultdict(list)
    for i in text:
        by_source[rows[i].source].append(i)
    names = sorted(by_source, key=lambda s: (s is not None, s))
    weight = {s: round(len(by_source[s]) ** 0.5, 6) for s in names}
    frame = min(65_536, max(1000, math.ceil(sum(weight.values()) / min(weight.values()))))
    slots = {s: max(1, math.floor(weight[s] * frame / sum(weight.values()) + 0.5)) for s in names}
    size, done, order = sum(slots.values()), collections.Counter(), {}
    for t in range(size):
        due = [(-(-(done[s] + 1) * size // slots[s]), k, s) for k, s in enumerate(names) if done[s] < slots[s] and done[s] * size // slots[s] <= t]
        if due:
            s = min(due)[2]
            order[s, done[s]] = t
            done[s] += 1
    place = {}
    for s in names:
        for rank, i in enumerate(sorted(by_source[s], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))):
            block = rank // 16
            place[i] = (block // slots[s] * size + order[s, block % slots[s]], rank % 16)
    # pieces of whole texts, packed
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in text.items():
        ids = np.array([*encode.encode(t, add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for p, end in enumerate([*range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [len(ids)]):
            want.add((i, p, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start = end
    got = corpus_pipeline.run(spark, sf).collect()
    assert {tuple(r)[:5] for r in (x for x in got)} == want and len(got) == len(want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    first = {}
    for s, members in sequences.items():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == np.cumsum([0, *[r.length for r in members]])[:-1].tolist()
        assert sum(r.length for r in members) <= 1024 and len(members) <= 16
        first[s] = min((*place[r.doc_id], r.piece) for r in members)
    assert [first[s] for s in sorted(first)] == sorted(first.values()) and sorted(first) == list(range(len(first)))
    # best fit, one piece at a time, needs as many sequences
    open_: list[list[int]] = []
    for n in sorted((w[3] for w in want), reverse=True):
        fits = [b for b in open_ if b[0] + n <= 1024 and b[1] < 16]
        if fits:
            best = max(fits, key=lambda b: b[0])
            best[0], best[1] = best[0] + n, best[1] + 1
        else:
            open_.append([n, 1])
    assert len(sequences) <= 1.02 * len(open_) + 1
