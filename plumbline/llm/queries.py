"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, hard_negatives, language, language_model, line_dedup, mixing, neighbours, packing, quality, repetition, simhash, substring, toxicity
from .common import fold, table


def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(fold("doc_id", modulus) == rest, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), modulus=4, held=2)
    return compression.scored(docs, model).select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = language_model.scored(docs, language_model.build(docs, modulus=7, held=2))
    return scores.select("doc_id", held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digests(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10),
m AS (SELECT k.*, o.key IS NOT NULL AS dropped FROM k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id, text
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), bits=2, shingle=3)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents")).drop("dup_char_shares")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mixing.schedule(table(spark, sf_dir, "documents"), block=16, temperature=0.5, frame=1000)
    return s.select(F.col("_id").alias("doc_id"), "source", "block", "position", "release", "deadline", "slot")


#: Earliest deadline first, slot by slot, over one frame; then every document's place by its rank.
OP7_SQL = r"""
WITH RECURSIVE n AS (SELECT source, round(pow(count(*)::DOUBLE, 0.5), 6) AS w FROM documents GROUP BY source),
z AS (SELECT least(65536, greatest(1000, ceil(sum(w) / min(w))))::BIGINT AS z, sum(w) AS total FROM n),
a AS (SELECT source, greatest(1, floor(w * z / total + 0.5)::BIGINT) AS a, row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM n, z),
f AS (SELECT list(a ORDER BY k) AS a, sum(a)::BIGINT AS size FROM a),
e AS (
  SELECT 0::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS done, NULL::STRUCT(due BIGINT, k BIGINT) AS c, NULL::BIGINT AS i FROM f
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: CASE WHEN j = p.k THEN x + 1 ELSE x END), p, done[p.k]
  FROM (SELECT e.t, e.done, f.size, list_min(list_transform(
      list_filter(range(1, len(f.a) + 1), lambda j: e.done[j] < f.a[j] AND (e.done[j] * f.size) // f.a[j] <= e.t),
      lambda j: {'due': ((e.done[j] + 1) * f.size + f.a[j] - 1) // f.a[j], 'k': j})) AS p
    FROM e, f WHERE e.t < f.size)),
s AS (SELECT c.k AS k, i, t - 1 AS slot FROM e WHERE c IS NOT NULL),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rk FROM documents),
b AS (SELECT r.*, rk // 16 AS block, rk % 16 AS position, a.a, a.k FROM r JOIN a ON r.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, b.source, block, position, (block * size) // b.a AS release, ((block + 1) * size + b.a - 1) // b.a AS deadline,
  (block // b.a) * size + slot AS slot
FROM b CROSS JOIN f JOIN s ON s.k = b.k AND s.i = block % b.a
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identified(docs, language.fit(docs, modulus=4, held=2))
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), tokens=1024, end_id=2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), modulus=5, held=0)
    return compression.scored(docs, model).select("doc_id", held_out(5, 0), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"), window=35).drop("spans")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT rid, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
s AS (SELECT rid, s.s AS pos, md5(array_to_string(words[s.s : s.s + 34], ' ')) AS seq FROM d, unnest(range(1, len(words) - 33)) AS s(s)),
r AS (SELECT rid, pos FROM s QUALIFY count(*) OVER (PARTITION BY seq) > 1),
m AS (SELECT w.*, max(CASE WHEN r.pos IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.rid ORDER BY w.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN r ON w.rid = r.rid AND w.pos = r.pos),
k AS (SELECT rid, count(*) AS n_removed FROM m WHERE gone = 1 GROUP BY rid),
t AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS kept FROM m WHERE gone = 0 GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid LEFT JOIN t ON d.rid = t.rid
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchors=F.col("id") % 100 == 0, relabel=shifted, scale=256, positives=5, negatives=5, least_percent=80).drop("positive_rank")


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS r, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, r) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.score DESC, n.id, n.r)::INTEGER AS rank, n.id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_language_model": op2_language_model,
        "op3_line_dedup": op3_line_dedup,
        "op4_simhash": op4_simhash,
        "op5_neighbours": op5_neighbours,
        "op6_repetition": op6_repetition,
        "op7_mixing": op7_mixing,
        "op8_language": op8_language,
        "op9_packing": op9_packing,
        "op10_toxicity": op10_toxicity,
        "op11_substring": op11_substring,
        "op12_hard_negatives": op12_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op7_mixing": OP7_SQL, "op11_substring": OP11_SQL, "op12_hard_negatives": OP12_SQL}
