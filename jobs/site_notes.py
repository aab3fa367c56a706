"""Reports on the notes that come with captures, by site and language, from the text tables.

For every site (source) and language: how many notes, how many of them are the first of their text (copies of one text on any site count once, where its least
note id is), words in all, median and 90th percentile of words a note, the longest notes, the site's commonest language with all votes, and what the
labels say of them. The report is partitioned by language and written whole, so that a second run gives the same files' rows; inputs are never changed.

Null texts are notes without words and copies of nothing. Null sites and languages are groups of their own. A note labelled twice counts its greatest label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import robust, rooms, windows

from .common import log_of, main

log = log_of("site_notes")
WORD = r"[^\x20\x09-\x0D]+"
BY = ["site", "lang"]
REPORT = "site string, notes long, originals long, words long, p50 double, p90 double, longest string, site_lang string, votes map<string,int>, labelled long, good long, toxic long, lang string"


def report(documents: DataFrame, labels: DataFrame, longest: int = 3) -> DataFrame:
    """site, lang and the measures; see the module."""
    notes = documents.select(F.col("doc_id"), F.col("source").alias("site"), "lang", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("words"), F.sha2("text", 256).alias("key"))
    # copies: a row for each text and group first, so that a text on a third of all rows meets itself in few
    texts = notes.filter("key IS NOT NULL").groupBy("key", *BY).agg(F.min("doc_id").alias("_id"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("_id").asc_nulls_last(), *BY))
    first = texts.withColumn("_place", place).groupBy(*BY).agg(F.count_if(F.col("_place") == 1).alias("_first"))
    counts = notes.groupBy(*BY).agg(F.count("*").alias("notes"), F.count_if(F.col("key").isNull()).alias("_empty"), F.sum("words").alias("words"))
    spread = robust.percentiles(notes, "words", [0.5, 0.9], BY)
    top = windows.top_k(notes, BY, [F.desc("words"), F.col("doc_id").asc_nulls_last()], longest, "_rank")
    entry = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit(":"), F.col("words"))
    top = top.groupBy(*BY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", entry.alias("e")))), lambda x: x["e"]), ",").alias("longest"))
    votes = rooms.majority(notes.select("site", "lang"), "lang", ["site"]).withColumnRenamed("lang", "site_lang")
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = notes.join(known, "doc_id").groupBy(*BY).agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    out = counts
    for part, keys in ((first, BY), (spread, BY), (top, BY), (marked, BY), (votes, ["site"])):
        part = part.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in part.columns if c not in keys])
        same = [out[k].eqNullSafe(part[f"_{k}"]) for k in keys]
        on = same[0] if len(same) == 1 else same[0] & same[1]
        out = out.join(part, on, "left").drop(*[f"_{k}" for k in keys])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("site", "notes", (F.coalesce("_first", F.lit(0)) + F.col("_empty")).alias("originals"), "words", "p50", "p90", "longest", "site_lang", "votes", zero("labelled"), zero("good"), zero("toxic"), "lang")


def run(spark: SparkSession, documents: str, labels: str, output: str, longest: int = 3) -> DataFrame:
    """Writes the report of notes by site and language; returns it."""
    notes, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    report(notes, marks, longest).write.mode("overwrite").partitionBy("lang").parquet(output)
    written = spark.read.schema(REPORT).parquet(output)
    rows, total, copies = written.agg(F.count("*"), F.coalesce(F.sum("notes"), F.lit(0)), F.coalesce(F.sum(F.col("notes") - F.col("originals")), F.lit(0))).first()
    log.info("read %d notes from %s (%d copies), wrote %d rows to %s", total, documents, copies, rows, output)
    return written


if __name__ == "__main__":
    main("site_notes", run, {"documents": "notes (Parquet: doc_id, text, lang, source)", "labels": "labels (Parquet: doc_id, quality, toxic)", "output": "folder of the report"})
