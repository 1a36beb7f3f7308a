"""Array files and chunk stores: what a slice reads, order, filters, large files and odd shapes."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtrail.sources import arrays, chunks


@pytest.fixture
def movie(tmp_path):
    a = np.random.default_rng(0).integers(0, 1000, (5, 3, 4, 6, 7)).astype(np.uint16)
    np.save(tmp_path / "m.npy", a)
    return a, str(tmp_path / "m.npy")


def rows_of(df, axes="tczyx"):
    return {tuple(r[k] for k in axes): r["v"] for r in df.collect()}


def test_a_slice_reads_only_its_chunks(spark, movie):
    a, path = movie
    want = {k: int(v) for k, v in np.ndenumerate(a)}
    whole = arrays.read_array(spark, path, "t,c,z,y,x", chunk_bytes=1000)
    assert rows_of(whole) == want and dict(whole.dtypes)["v"] == "bigint" and whole.first().movie == "m"
    some = arrays.read_array(spark, path, "t,c,z,y,x", chunk_bytes=400, t=(3, 4), c=(1, 3), y=(2, 4))
    assert rows_of(some) == {k: v for k, v in want.items() if k[0] == 3 and k[1] > 0 and 2 <= k[3] < 4}
    plan = lambda **b: arrays.ArrayFiles({"path": path, "axes": "t,c,z,y,x", "chunkBytes": "400", "bounds": json.dumps(b)}).reader(None).partitions()
    # A slice of one frame and channel has 4 * 6 * 7 values of two bytes: 336, one for each chunk.
    assert len(plan()) == 15 and sum(c.n_bytes for c in plan()) == a.nbytes
    assert len(plan(t=(3, 4), c=(1, 3))) == 2 and sum(c.n_bytes for c in plan(t=(3, 4), c=(1, 3))) == 2 * 336


def test_filters_are_pushed_down(spark, movie):
    a, path = movie
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = arrays.read_array(spark, path, "t,c,z,y,x", chunk_bytes=400).filter("t >= 2 and t < 4 and c in (0, 2) and z = 1 and v > 500")
        assert rows_of(df) == {k: int(v) for k, v in np.ndenumerate(a) if 2 <= k[0] < 4 and k[1] != 1 and k[2] == 1 and v > 500}
        assert df.rdd.getNumPartitions() == 4
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_files_over_two_gigabytes_are_read_in_ranges(spark, tmp_path):
    path, shape = tmp_path / "large.npy", (3000, 1, 1024, 1024)
    with open(path, "wb") as f:
        np.lib.format.write_array_header_2_0(f, {"descr": "|u1", "fortran_order": False, "shape": shape})
        start = f.tell()
        f.seek(start + 2990 * 1024 * 1024 + 5 * 1024 + 9)
        f.write(b"\x2a")
        f.truncate(start + 3000 * 1024 * 1024)  # 3 GB, of which almost nothing is on disk
    df = arrays.read_array(spark, str(path), t=(2990, 2991), y=(4, 7))
    assert df.count() == 3 * 1024 and [(r.t, r.y, r.x, r.v) for r in df.filter("v <> 0").collect()] == [(2990, 5, 9, 42)]


def test_floats_fortran_order_folders_and_empty_arrays(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(2, 3, 4, 5))
    np.save(tmp_path / "a.npy", np.asfortranarray(a))
    np.save(tmp_path / "b.npy", np.zeros((0, 3, 4, 5)))
    (tmp_path / "more").mkdir()
    np.save(tmp_path / "more" / "c.npy", a[:1])
    got = {(r.movie, r.t, r.z, r.y, r.x): r.v for r in arrays.read_array(spark, f"file://{tmp_path}", chunk_bytes=64).collect()}
    assert got == {("a", *k): v for k, v in np.ndenumerate(a)} | {("c", *k): v for k, v in np.ndenumerate(a[:1])}
    np.save(tmp_path / "more" / "d.npy", np.zeros(3))
    with pytest.raises(Exception, match="1 axes"):
        arrays.read_array(spark, str(tmp_path)).count()


def pixel_rows(spark, a):
    return spark.createDataFrame([("m", *map(int, k), float(v), "x") for k, v in np.ndenumerate(a)], "movie string, t int, z int, c int, y int, x int, v double, level string")


def test_a_store_gives_slices_of_every_level(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 50, (3, 2, 2, 10, 12)).astype(float)
    path = str(tmp_path / "store")
    chunks.write(pixel_rows(spark, a), path, levels=2, side=4)
    whole = rows_of(chunks.read(spark, path, 4), "tzcyx")
    assert whole == dict(np.ndenumerate(a))
    half = a.reshape(3, 2, 2, 5, 2, 6, 2).mean((4, 6))
    got = rows_of(chunks.read(spark, path, 4, level=1), "tzcyx")
    assert got.keys() == dict(np.ndenumerate(half)).keys() and all(abs(got[k] - v) < 1e-9 for k, v in np.ndenumerate(half))
    part = chunks.read(spark, path, 4, channels=[1], t=(1, 2), z=(0, 1), y=(3, 6), x=(8, 9))
    assert rows_of(part, "tzcyx") == {k: v for k, v in np.ndenumerate(a) if k[0] == 1 and k[1] == 0 and k[2] == 1 and 3 <= k[3] < 6 and k[4] == 8}
    assert chunks.chunks(spark, path, 4, channels=[1], t=(1, 2), z=(0, 1), y=(3, 6), x=(8, 9)).count() == 2  # of 108 at this level
    plan = part._jdf.queryExecution().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert re.match(r"PartitionFilters: \[[^\]]*level#\d+ = 0[^\]]*", scan) and re.search(r"PushedFilters: \[\w+\(", scan), scan
    chunks.write(pixel_rows(spark, a[:1] * 2).withColumn("t", F.lit(1)), path, levels=2, side=4)
    again = rows_of(chunks.read(spark, path, 4), "tzcyx")
    assert all(again[k] == (2 * a[(0, *k[1:])] if k[0] == 1 else a[k]) for k in whole)


def test_an_empty_store(spark, tmp_path):
    chunks.write(pixel_rows(spark, np.zeros((0, 1, 1, 1, 1)) + 0.0).filter("false"), str(tmp_path / "none"))
    assert chunks.read(spark, str(tmp_path / "none"), t=(0, 9)).count() == 0
