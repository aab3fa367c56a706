"""The runnable jobs as queries: each runs its job twice into one new folder and gives what the second run left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import sightings, site_notes

from ..operators.graph import shared_dir
from . import query


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, * FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
g AS (SELECT day, user_id AS capture_id, event_type AS class, count(*) AS n, sum(value::DECIMAL(28,6))::DOUBLE AS total, min(ts) AS first_ts, max(ts) AS last_ts,
  arg_min(event_id, (-value, event_id)) AS best_event, max(value) AS best_value FROM e GROUP BY ALL)
SELECT day, capture_id, class, n, total, epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us, best_event, best_value,
  row_number() OVER (PARTITION BY day, capture_id ORDER BY n DESC, class)::INTEGER AS rank FROM g""")
def job1_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(spark)}/job1-sightings-{uuid.uuid4().hex}"
    for _ in range(2):
        out = sightings.run(spark, f"{sf_dir}/events.parquet", f"{where}/output", f"{where}/checkpoint")
    micros = "unix_micros(CAST({0}_ts AS TIMESTAMP)) AS {0}_us"
    return out.selectExpr("day", "capture_id", "class", "n", "total", micros.format("first"), micros.format("last"), "best_event", "best_value", "rank")


@query(r"""WITH n AS (SELECT doc_id, source AS site, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, text FROM documents),
f AS (SELECT site, lang, count(*) AS k FROM (SELECT site, lang FROM n WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, site, lang) = 1) GROUP BY ALL),
v AS (SELECT site, lang AS site_lang FROM n WHERE lang IS NOT NULL GROUP BY site, lang QUALIFY row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, lang) = 1),
t AS (SELECT site, lang, string_agg(doc_id::VARCHAR || ':' || words::VARCHAR, ',' ORDER BY r) AS longest FROM
  (SELECT *, row_number() OVER (PARTITION BY site, lang ORDER BY words DESC, doc_id) AS r FROM n QUALIFY r <= 3) GROUP BY ALL),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY ALL)
SELECT n.site, n.lang, count(*) AS notes, coalesce(any_value(f.k), 0) + count(*) FILTER (WHERE text IS NULL) AS originals, sum(words)::BIGINT AS words, round(quantile_cont(words, 0.5), 6) AS p50, round(quantile_cont(words, 0.9), 6) AS p90,
  any_value(longest) AS longest, any_value(site_lang) AS site_lang, count(l.doc_id) AS labelled, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
FROM n LEFT JOIN f ON n.site IS NOT DISTINCT FROM f.site AND n.lang IS NOT DISTINCT FROM f.lang LEFT JOIN t ON n.site IS NOT DISTINCT FROM t.site AND n.lang IS NOT DISTINCT FROM t.lang
LEFT JOIN v ON n.site IS NOT DISTINCT FROM v.site LEFT JOIN l ON n.doc_id = l.doc_id GROUP BY n.site, n.lang""")
def job2_site_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(spark)}/job2-site-notes-{uuid.uuid4().hex}"
    for _ in range(2):
        out = site_notes.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", where)
    return out.drop("votes").withColumns({c: F.round(c, 6) for c in ("p50", "p90")})
