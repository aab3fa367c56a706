"""The jobs: two runs over growing input (on copies), runs that die half-way, odd rows, the command line."""

from __future__ import annotations

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import sightings, site_notes
from tests.conftest import ROOT


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).drop("through").collect()))


@pytest.fixture()
def growing(spark, sf, tmp_path):
    """A folder of event files that the test adds to, the events in it, and a fresh output."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value").cache()
    where = str(tmp_path / "events")

    def add(condition: str, files: int = 2):
        events.filter(condition).repartition(files).write.mode("append").parquet(where)

    yield add, where, events, str(tmp_path / "out"), str(tmp_path / "progress")
    events.unpersist()


def expected(events):
    """The report of all events at once."""
    spark = events.sparkSession
    events.createOrReplaceTempView("job_events")
    return spark.sql("""SELECT date_format(ts, 'yyyy-MM-dd') AS day, user_id AS capture_id, event_type AS class, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total,
        min(ts) AS first_ts, max(ts) AS last_ts, max_by(event_id, struct(value, -event_id)) AS best_event, max(value) AS best_value,
        row_number() OVER (PARTITION BY date_format(ts, 'yyyy-MM-dd'), user_id ORDER BY count(*) DESC, event_type) AS rank FROM job_events GROUP BY 1, 2, 3""")


def test_only_what_is_new(spark, growing):
    add, where, events, out, progress = growing
    add("event_id % 3 = 0")
    assert rows(sightings.run(spark, where, out, progress)) == rows(expected(events.filter("event_id % 3 = 0")))
    day = events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    add(f"event_id % 3 <> 0 AND date_format(ts, 'yyyy-MM-dd') = '{day}'")
    before = {r.day: r.through for r in spark.read.schema(sightings.REPORT).parquet(f"{out}/report").select("day", "through").distinct().collect()}
    assert sightings.take_new(spark, where, out, progress, 64) == [1]
    assert sightings.publish(spark, out) == 1  # one day only is written again
    after = {r.day: r.through for r in spark.read.schema(sightings.REPORT).parquet(f"{out}/report").select("day", "through").distinct().collect()}
    assert after == before | {day: 1}
    add(f"event_id % 3 <> 0 AND date_format(ts, 'yyyy-MM-dd') <> '{day}'", 5)
    assert rows(sightings.run(spark, where, out, progress, files_per_batch=2)) == rows(expected(events))
    assert sightings.take_new(spark, where, out, progress, 64) == [] and sightings.publish(spark, out) == 0
    assert rows(sightings.run(spark, where, out, progress)) == rows(expected(events))


def test_a_run_that_dies_is_mended(spark, growing, monkeypatch):
    add, where, events, out, progress = growing
    add("event_id % 2 = 0")
    sightings.run(spark, where, out, progress)
    add("event_id % 2 = 1")
    plain = sightings.increment
    calls = []

    def dies(events):
        calls.append(1)
        plain(events).withColumn("batch", F.lit(1).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{out}/increments")
        raise RuntimeError("lost")

    monkeypatch.setattr(sightings, "increment", dies)  # the increment is written, its batch isn't noted
    with pytest.raises(Exception, match="lost"):
        sightings.run(spark, where, out, progress)
    monkeypatch.setattr(sightings, "increment", plain)
    assert calls and sightings.take_new(spark, where, out, progress, 64) == [1]  # and dies before the report is written
    assert rows(sightings.run(spark, where, out, progress)) == rows(expected(events))


def test_odd_events(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, extra string"
    data = [(1, None, 1, "a", 1.0), (2, "2024-01-01 00:00:00", None, "a", 1.0), (3, "2024-01-01 00:00:00", 1, None, 1.0), (4, "2024-01-01 00:00:00", 1, "a", None), (None, "2024-01-01 00:00:01", 1, "a", 2.0), (6, "2024-01-01 00:00:02", 1, "a", 2.0), (6, "2024-01-01 00:00:02", 1, "a", 2.0)]
    where, out, progress = (str(tmp_path / x) for x in ("events", "out", "progress"))
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(where)
    assert sightings.run(spark, where, out, progress).count() == 0
    d = spark.createDataFrame([(*r, "x") for r in data], schema.replace("ts timestamp_ntz", "ts string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    d.write.mode("append").parquet(where)
    got = sightings.run(spark, where, out, progress).collect()
    assert [(r.capture_id, r["class"], r.n, r.total, r.best_event, r.best_value, r.rank) for r in got] == [(1, "a", 4, 6.0, 6, 2.0, 1)]


def test_site_notes(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "a b c", "s", "en"), (2, "a b c", "s", "en"), (3, "a b c", "t", "en"), (4, None, "s", "en"), (5, "", None, None), (6, " x\ty\n", "s", "de"), (7, "one", "s", "de"), (8, "two words", "s", "de"), (None, "two words", "s", "de"), (9, "a b c d", "t", "fr")],
        "doc_id long, text string, source string, lang string",
    )
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (6, None, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "d"))
    labels.write.parquet(str(tmp_path / "l"))
    out = [site_notes.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "o")).collect() for _ in range(2)]
    got = {(r.site, r.lang): r for r in out[1]}
    pick = lambda r: (r.notes, r.originals, r.words, r.p50, r.longest, r.site_lang, r.labelled, r.good, r.toxic)
    assert {k: pick(r) for k, r in got.items()} == {
        ("s", "en"): (3, 2, 6, 3.0, "1:3,2:3,4:0", "de", 1, 1, 1),
        ("t", "en"): (1, 0, 3, 3.0, "3:3", "en", 0, 0, 0),
        ("s", "de"): (4, 3, 7, 2.0, "6:2,8:2,?:2", "de", 1, 0, 0),
        ("t", "fr"): (1, 1, 4, 4.0, "9:4", "en", 0, 0, 0),
        (None, None): (1, 1, 0, 0.0, "5:0", None, 0, 0, 0),
    }
    assert got["s", "en"].votes == {"en": 3, "de": 4}
    assert sorted(map(str, out[0])) == sorted(map(str, out[1]))
    assert site_notes.report(docs.limit(0), labels.limit(0)).count() == 0


def test_command_line(sf, tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"longest": 2, "labels": f"{sf}/labels.parquet"}))
    done = subprocess.run(
        [sys.executable, "-m", "jobs.site_notes", "--config", str(config), "--documents", f"{sf}/documents.parquet", "--output", str(tmp_path / "out")],
        cwd=ROOT, capture_output=True, text=True, timeout=180, check=False,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 notes" in done.stderr and (tmp_path / "out" / "_SUCCESS").exists()
    bad = subprocess.run([sys.executable, "-m", "jobs.sightings", "--config", str(config)], cwd=ROOT, capture_output=True, text=True, timeout=60, check=False)
    assert bad.returncode == 2 and "no path for events, output, checkpoint" in bad.stderr


def test_jobs_stand_alone():
    """Neither the jobs nor this test load the training-data operators."""
    code = "import sys, jobs.sightings, jobs.site_notes, tests.test_jobs; assert not [m for m in sys.modules if m.startswith('plumbline.llm') or m == 'corpus_pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=60, check=False).returncode == 0
