"""The streaming tracker gives what the batch tracker gives."""

import pandas as pd
from pyspark.sql import functions as F

from voxtrail.operators import tracking
from voxtrail.streaming.tracker import track_stream, windowed_displacement

SCHEMA = "movie string, t int, cell_id int, z_um double, y_um double, x_um double"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("m", t, c, 0.0, 60.0 * c, 2.0 * t) for t in range(6) for c in range(3)]
    for t in range(6):
        part = pd.DataFrame([r for r in rows if r[1] == t], columns=SCHEMA.replace(",", "").split()[::2])
        part.astype({"t": "int32", "cell_id": "int32"}).to_parquet(tmp_path / f"{t}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path))
    q = track_stream(stream).writeStream.format("memory").queryName("points").outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    got = spark.table("points").orderBy("t", "cell_id").toPandas()
    want = tracking.run(pd.DataFrame(rows, columns=SCHEMA.replace(",", "").split()[::2])).sort_values(["t", "cell_id"])
    assert got.track_id.tolist() == want.track_id.tolist()


def test_windowed_displacement(spark):
    df = spark.createDataFrame([("m", f"2024-01-01 00:0{i}:00", 1.0, 2.0) for i in range(5)], "movie string, ts string, u double, v double").withColumn("ts", F.to_timestamp("ts"))
    out = windowed_displacement(df, "ts").orderBy("window").collect()
    assert max(r.u for r in out) == 5.0 and sum(r.n for r in out) == 25
