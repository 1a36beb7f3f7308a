"""Both jobs on copies of the tables: growing input, reruns, cut-off batches, odd rows and the command line."""

import logging
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobs import feature_screening, track_quality
from jobs.queries import MAX_GAP, ORACLE

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.01"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string, t string, movie string, batch string"


def by_sql(query, **tables):
    with duckdb.connect() as con:
        for name, files in tables.items():
            con.sql(f"create view {name} as select * from read_parquet({files!r})")
        return con.sql(ORACLE[query]).df()


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    texts = lambda df: sorted(map(tuple, df[columns].map(lambda x: "none" if pd.isna(x) else str(round(x, 9) + 0.0) if isinstance(x, float) else str(x)).values))
    assert texts(got) == texts(want)


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


@pytest.fixture
def growing(tmp_path, spark):
    """Three parts of the events: some days late, some events twice."""
    events = pd.read_parquet(f"{SF}/events.parquet")
    day = (events.ts - pd.Timestamp("2024-01-01")).dt.days
    late = (events.event_id % 17 == 0) & (day < 10)
    parts = [events[(day < 12) & ~late], events[((day >= 12) & (day < 20)) | late], pd.concat([events[day >= 20], events[day == 25]])]
    for i, part in enumerate(parts):
        part.to_parquet(tmp_path / f"part-{i}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return [tmp_path / f"part-{i}.parquet" for i in range(3)]


def test_report_follows_growing_events(spark, tmp_path, growing, caplog):
    caplog.set_level(logging.INFO, "track_quality")
    table = tmp_path / "events.parquet"
    table.mkdir()
    out, checkpoint, before = str(tmp_path / "out"), str(tmp_path / "checkpoint"), {}
    for i, part in enumerate(growing):
        shutil.copy(part, table / f"{i}.parquet")
        got = track_quality.run(spark, str(table), out, checkpoint, MAX_GAP).toPandas()
        same(got, by_sql("job1_track_quality", events=[str(p) for p in growing[: i + 1]]))
        now = files(f"{out}/report")
        if i == 2:  # the third part begins on day 20: nothing before day 19 can change
            kept = {f for f in before if int(f.split("t=")[1].split("/")[0]) < 19}
            assert kept and all(now[f] == before[f] for f in kept)
            assert not any(now.get(f) == before[f] for f in before if int(f.split("t=")[1].split("/")[0]) >= 19)
        before = now
    said = [r.getMessage() for r in caplog.records if "batch " in r.getMessage()]
    assert [int(m.split("read ")[1].split()[0]) for m in said] == [len(pd.read_parquet(p)) for p in growing]
    again = track_quality.run(spark, str(table), out, checkpoint, MAX_GAP).toPandas()
    same(again, got)
    assert files(f"{out}/report") == before


def test_a_batch_that_was_cut_off_is_taken_again(spark, tmp_path, growing):
    table = tmp_path / "events.parquet"
    table.mkdir()
    out, checkpoint = tmp_path / "out", tmp_path / "checkpoint"
    for i in (0, 1):
        shutil.copy(growing[i], table / f"{i}.parquet")
        got = track_quality.run(spark, str(table), str(out), str(checkpoint), MAX_GAP).toPandas()
    # As after a loss between the writing of a batch and its commit, with half of the report gone.
    for f in (checkpoint / "commits").glob("*1"):
        f.unlink()
    for f in (checkpoint / "commits").glob(".*1.crc"):
        f.unlink()
    for t in range(13, 16):
        shutil.rmtree(out / "report" / f"t={t}")
    again = track_quality.run(spark, str(table), str(out), str(checkpoint), MAX_GAP).toPandas()
    same(again, got)
    assert len(list((out / "detections").glob("batch=*"))) == 2


def test_files_are_taken_in_several_batches(spark, tmp_path, growing):
    table = tmp_path / "events.parquet"
    table.mkdir()
    for i, part in enumerate(growing):
        shutil.copy(part, table / f"{i}.parquet")
    got = track_quality.run(spark, str(table), str(tmp_path / "out"), str(tmp_path / "checkpoint"), MAX_GAP, files_per_batch=1).toPandas()
    same(got, by_sql("job1_track_quality", events=[str(p) for p in growing]))
    assert len(list((tmp_path / "out" / "detections").glob("batch=*"))) == 3


def test_events_without_time_or_user_and_empty_tables(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "track_quality")
    rows = [(1, "2024-01-01 05:00:00", 5, "click", 1.0), (2, "2024-01-01 06:00:00", 5, None, 1.0), (3, None, 5, "click", 1.0), (4, "2024-01-03 00:00:00", None, "view", 1.0), (None, "2024-01-03 00:00:00", 5, "view", None)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    for name in ("props", "t", "movie", "batch"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(str(tmp_path / "odd.parquet"))
    got = {(r.movie, r.t): r for r in track_quality.run(spark, str(tmp_path / "odd.parquet"), str(tmp_path / "out"), str(tmp_path / "c")).collect()}
    assert {k: (r.n_cells, r.n_dim) for k, r in got.items()} == {("m0", 0): (1, 1), ("m0", 2): (1, 0)}
    assert "left out 2 without" in caplog.text
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "empty.parquet"))
    for _ in range(2):
        assert track_quality.run(spark, str(tmp_path / "empty.parquet"), str(tmp_path / "out2"), str(tmp_path / "c2")).count() == 0


def test_screening_equals_sql_and_reruns(spark, tmp_path):
    out = str(tmp_path / "out")
    want = by_sql("job2_feature_screening", documents=[f"{SF}/documents.parquet"], labels=[f"{SF}/labels.parquet"])
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    for _ in range(2):
        same(feature_screening.run(spark, f"{SF}/documents.parquet", f"{SF}/labels.parquet", out).toPandas(), want)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    assert {p.parent.parent.name for p in Path(out).rglob("*.parquet")} == {"label=quality", "label=toxic"}


def test_screening_of_odd_rows(spark, tmp_path):
    docs = [(1, "A1 b!", "en", 7), (2, None, "en", 7), (3, "", "", 7), (4, "word " * 50_000, None, 7), (5, "Ünï 9\n", "de", 7), (5, "Ünï 9\n", "de", 7), (None, "no id", "en", 7)]
    marks = [(1, 1, 0), (2, 0, None), (3, 1, 1), (4, 0, 0), (5, 1, 1), (5, 0, 1), (None, 1, 1), (9, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, value long").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "l"))
    got = feature_screening.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "out")).toPandas()
    same(got, by_sql("job2_feature_screening", documents=[str(tmp_path / "d" / "*.parquet")], labels=[str(tmp_path / "l" / "*.parquet")]))
    empty = spark.read.parquet(str(tmp_path / "d")).filter("false")
    assert feature_screening.screen(empty, spark.read.parquet(str(tmp_path / "l"))).count() == 0


def test_command_lines(tmp_path):
    env = os.environ | {"PYTHONPATH": ""}
    run = lambda *a: subprocess.run([sys.executable, *a], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    (tmp_path / "own.toml").write_text(f'events = "{SF}/events.parquet"\nout = "{tmp_path}/wrong"\ncheckpoint = "{tmp_path}/c"\nmax_gap = 3\nfiles_per_batch = 5\n')
    done = run(str(ROOT / "jobs/track_quality.py"), "--config", "own.toml", "--out", f"{tmp_path}/right")
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 10000 events" in done.stderr and (tmp_path / "right/report").is_dir() and not (tmp_path / "wrong").exists()
    done = run(str(ROOT / "jobs/feature_screening.py"), "--documents", f"{SF}/documents.parquet", "--labels", f"{SF}/labels.parquet", "--out", f"{tmp_path}/screen")
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 1000 documents" in done.stderr


def test_jobs_stand_alone():
    for f in (ROOT / "jobs").glob("*.py"):
        assert "llm" not in f.read_text() and "corpus_pipeline" not in f.read_text()
