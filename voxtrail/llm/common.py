"""What the text operators share: table access, held-out folds and bounded training samples."""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a sample for each bucket of a range.
SAMPLED = 10
#: Arrow's buffers double as they grow, on either side of each worker, so large batches cost several times their size.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_RESOLUTION = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of `sf_dir`, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id gives -1, in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def slices(values: pa.Array, rows: int = 500, size: int = 4_000_000) -> Iterator:
    """The values of an Arrow array of strings, of which few at a time are Python objects: `rows`, or about `size` bytes."""
    ends, at = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(values):
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield from values.slice(at, stop - at).to_pylist()
        at = stop


def bounded_batches(spark: SparkSession) -> None:
    """Lets the session's Arrow batches have BATCH_BYTES at most, whatever the length of texts; a smaller setting stays."""
    size = spark.conf.get(_BATCH_SETTING)
    if size.rstrip("b").isdigit() and int(size.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def per_worker(spark: SparkSession, make: Callable, *plain) -> Callable[[], Any]:
    """A function that gives make(*plain) in Python workers, made once in each and kept for later tasks.

    `plain` is broadcast and must be of built-in types or arrays, so that workers need no module of this
    package; `make` travels by value.  What is made is kept beside the broadcast data, which workers hold on to.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast({"plain": plain})

    def get():
        store = shared.value
        if "made" not in store:
            store["made"] = make(*store["plain"])
            gc.freeze()  # tables without cycles, not to be searched again and again
            gc.set_threshold(200_000, 20, 100)
        return store["made"]

    return get


def bounded_sample(df: DataFrame, text: str, max_chars: int, by: list[str]) -> DataFrame:
    """Rows of about `max_chars` characters in all, chosen by a hash of `by`.

    Every row stays while the rows hold `max_chars` characters or fewer.  The
    choice depends on the rows alone, not on their order or partitions.
    """
    total = df.agg(F.sum(F.length(text))).first()[0] or 0
    if total <= max_chars:
        return df
    return df.filter(F.pmod(F.xxhash64(*by), F.lit(_RESOLUTION)) < int(_RESOLUTION * max_chars / total))


def range_key(key: str, *ties: Column) -> Column:
    """What rows are ordered by: whether `key` is there, its value, and the ties' values, all as integers."""
    parts = [F.col(key).isNotNull().cast("int"), F.coalesce(F.col(key).cast("long"), F.lit(0)), *ties]
    return F.named_struct(*[x for i, p in enumerate(parts) for x in (F.lit(f"k{i}"), p.cast("bigint"))])


def range_buckets(df: DataFrame, key: Column, rows: int, most: int) -> tuple[Column, int]:
    """A column that gives consecutive values of the struct `key` the same number, and how many numbers there are.

    A bucket has about `rows` rows, and there are `most` buckets at most.  Bounds are values of `key`, made by `range_key`, in a sample
    of about SAMPLED rows for each bucket, as far apart as there, so neither gaps nor outliers
    make a bucket large.  Equal keys share a bucket; greater ones never have a smaller number.
    """
    count = df.count()
    parts = max(1, min(most, -(-count // rows)))
    if parts == 1:
        return F.lit(0), 1
    share = min(1.0, SAMPLED * parts / count)
    sample = df.select(key.alias("k")).sample(False, share, 7).select("k.*").toPandas()
    names = list(sample.columns)
    sample = sample.sort_values(names, ignore_index=True)
    cuts = sample.iloc[np.unique(np.arange(1, parts) * len(sample) // parts)].drop_duplicates() if len(sample) else sample
    # Bounds are looked up in two steps, among the first ones of runs of them and then in one run.
    width = max(1, int(np.ceil(np.sqrt(len(cuts)))))
    runs = [cuts.iloc[i : i + width] for i in range(0, len(cuts), width)]
    kind = "struct<" + ",".join(f"{n}:bigint" for n in names) + ">"
    told = lambda table: [{n: int(v) for n, v in zip(names, r)} for r in table.itertuples(index=False)]
    firsts = F.from_json(F.lit(json.dumps([told(r.iloc[:1])[0] for r in runs])), f"array<{kind}>")
    all_ = F.from_json(F.lit(json.dumps([told(r) for r in runs])), f"array<array<{kind}>>")
    run = F.size(F.filter(firsts, lambda x: x <= key))
    within = F.size(F.filter(F.element_at(all_, F.greatest(run, F.lit(1))), lambda x: x <= key))
    return F.when(run == 0, 0).otherwise((run - 1) * width + within).cast("int"), len(cuts) + 1
