"""The corpus pipeline: toxic documents go, common lines go, one document of each near-duplicate group stays, the sources are mixed to
their target weights, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared folder and reads
them again as the next one's docs, and deletes the tables that a stage wrote on its way. All stages but the last return the columns of
documents (and any further ones that the table has, whatever their names). Mixing keeps every row: its decision is the order of the rows in
the files, which packing follows.

Null and empty texts aren't toxic, have one empty line, share the fingerprint zero and so go into one group of copies, and are packed as one
end token. Rows whose id is null stay or go like any others; of a group of copies the least id that isn't null stays, and of equal rows one. A
labels table without both classes takes no document. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import line_dedup, mixing, packing, simhash, toxicity
from plumbline.llm.common import stored_alone, table

#: No stage can be written in SQL: the classifier, the fingerprints' hash and the tokenizer have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from labels and the documents here. Without both classes all stay."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), modulus=5, held=0)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten or more documents go from all; n_chars is counted anew."""
    kept = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.selectExpr(*[f"CASE WHEN text IS NULL THEN n_chars ELSE CAST(length(text) AS {t}) END AS n_chars" if c == "n_chars" else f"`{c}`" for c, t in kept.dtypes])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group whose fingerprints link at two bits."""
    return simhash.keep_one(docs, bits=2, shingle=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix: blocks of 16 of each source, weights the square roots of the sources' counts."""
    return mixing.mixed(docs, block=16, temperature=0.5, frame=1000)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences of at most 1024 tokens and 16 pieces, both in the order of the mix: sequences are numbered by
    their earliest piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), tokens=1024, documents=16, end_id=2, follow=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_alone(spark, partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
