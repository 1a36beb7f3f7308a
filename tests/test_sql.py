"""SQL functions against the DataFrame operators of the same meaning."""

import pytest
from pyspark.sql import functions as F

from voxtrail import sql
from voxtrail.operators import scoring, tiles, vectors


@pytest.fixture(scope="module", autouse=True)
def names(spark):
    return sql.register(spark)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    want = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert spark.sql("select vec_dot(a, b), vec_norm(a), vec_cosine(a, b) from {d}", d=df).collect() == want
    assert spark.sql("select scale_between(5, 0, 10), scale_between(-1, 0, 10), scale_between(11, 0, 10)").first()[:] == (pytest.approx(0.5), 0.0, pytest.approx(1.0))


def test_tracks(spark):
    rows = [("m", k, t, c) for k, colours in enumerate([(0, 1, 1, -1, 0), (2, 2, 2), (-1, -1), (1, -1, 1), (3, 1, 3, 1)]) for t, c in enumerate(colours)]
    df = spark.createDataFrame(rows, "movie string, track_id long, t int, color_id int")
    got = spark.sql("select movie, track_id, color_switches(p) as switches, color_known(p) - 1 as transitions, dominant_color(p) as dominant_color from (select movie, track_id, collect_list(struct(t, color_id as color)) as p from {d} group by all)", d=df)
    want = scoring.track_switches(df).select("movie", "track_id", "switches", "transitions", "dominant_color")
    assert sorted(got.filter("transitions >= 1").collect()) == sorted(want.collect())
    assert got.filter("track_id = 2").first()[2:] == (0, -1, -1)


@pytest.mark.parametrize("length,size,overlap", [(300, 224, 0.1), (16, 12, 0.1), (10, 12, 0.1), (1000, 100, 0.25)])
def test_tiles(spark, length, size, overlap):
    got = spark.sql(f"select tile, start from tile_starts({length}, {size}, {overlap}D)").collect()
    assert sorted(map(tuple, got)) == list(enumerate(tiles.starts(length, size, overlap)))


def test_table_functions_of_rows(spark, names):
    df = spark.createDataFrame([(1, 3), (2, None)], "k int, n int")
    assert spark.sql("select k, c.* from {d}, lateral crop_offsets(n) c", d=df).count() == 36
    assert sorted(r.frame for r in spark.sql("select f.frame from {d}, lateral frames_around(k, 1, 2) f where k = 1", d=df).collect()) == [0, 1, 2, 3]
    assert spark.sql("select t.* from {d}, lateral tile_starts(n, 2, 0D) t where k = 2", d=df).count() == 0
    assert len(names) == len(set(names)) == len(sql.FUNCTIONS)
