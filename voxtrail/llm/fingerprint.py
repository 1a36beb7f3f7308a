"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a
text's word shingles.  Sketches of parts merge to the sketch of the whole, and
two of them estimate resemblance, containment and the number of distinct shingles.

Defined cases: a null or blank text has an empty sketch; a text of fewer words
than a shingle has one shingle, all its words; two empty sketches resemble each
other fully; repeated words and rows change nothing but their own rows; an empty table
stays empty; a text of any length is hashed whole; further columns are left out by `fingerprint_documents`, and their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from voxtrail.llm.common import range_buckets, range_key

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
BUCKET_ROWS = 2000
MAX_BUCKETS = 100_000


def add_sketch(df: DataFrame, text: str, out: str, k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds array column `out`, the bottom-k sketch of column `text`.

    Words are hashed once; a shingle's hash is that of its words' hashes, so the
    work for each word is a few 8-byte hashes and no string is built.
    """
    hashes = f"{out}__h"
    pieces = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    df = df.withColumn(hashes, F.transform(pieces, lambda w: F.xxhash64(w)))
    h, n = F.col(hashes), F.size(hashes)
    whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
    shingles = F.when(n < words, whole).otherwise(F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)])))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(hashes)


def union(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of two texts taken together."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard likeness, 0 to 1; exact while the union fits in a sketch."""
    both = union(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of the first text's shingles that the second has too."""
    whole = distinct_shingles(union(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * whole / distinct_shingles(a, k)))


def to_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash, in the sketch's order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge(df: DataFrame, by: list[str], sketch: str, k: int = SKETCH_SIZE, fan: int = 256) -> DataFrame:
    """One sketch for each group of `by`, from its parts' sketches.

    Parts meet in `fan` salted groups first, so a group of many parts is never
    gathered by one task.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(sketch), F.lit(fan)))
    for keys in ([*by, "__salt"], by):
        smallest = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set(sketch)))), 1, k)
        salted = salted.groupBy(*keys).agg(smallest.alias(sketch))
    return salted


def with_next(df: DataFrame, order: str, text: str) -> tuple[DataFrame, WindowSpec]:
    """Adds `next_text`, that of the next row by descending `order`, and after the last the first's.

    Rows go to range buckets by order in one exchange that carries each text once.  A bucket's first row is
    also sent to the bucket before it (`aux` marks such copies; drop them when done), so buckets
    are independent.  Nulls come last; equal ids are ordered by their text's hash, and rows equal in both by
    their place in the input, so no id has too many rows for buckets.  There are MAX_BUCKETS
    buckets at most, which bounds what the driver holds of them.
    """
    spark = df.sparkSession
    df = df.withColumn("__place", F.monotonically_increasing_id())
    key = range_key(order, F.xxhash64(text), F.col("__place"))
    bucket, _ = range_buckets(df, key, BUCKET_ROWS, MAX_BUCKETS)
    columns = [c for c in df.columns if c != "__place"]
    heads = [(r[0], r[1]) for r in df.select(bucket.alias("b"), key.alias("k"), "__place").groupBy("b").agg(F.max_by("__place", "k")).collect()]
    heads.sort(reverse=True)
    sent = [(place, heads[i - 1][0]) for i, (_, place) in enumerate(heads)]  # the first bucket's head goes round to the last
    to = spark.createDataFrame(sent, "__head long, __to int")
    places = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("aux")), F.when(F.col("__to").isNotNull(), F.struct(F.col("__to").alias("bucket"), F.lit(True).alias("aux")))))
    rows = df.join(F.broadcast(to), F.col("__place") == F.col("__head"), "left").select(*columns, key.alias("__key"), F.explode(places).alias("__at"))
    rows = rows.select(*columns, "__key", F.col("__at.bucket").alias("__bucket"), F.col("__at.aux").alias("__aux"))
    w = Window.partitionBy("__bucket").orderBy("__aux", F.desc("__key"))
    return rows.withColumn("next_text", F.lead(text).over(w)), w


def fingerprint_documents(docs: DataFrame, k: int = SKETCH_SIZE) -> DataFrame:
    """Fingerprints of every text and of its text with the latter half replaced by the next document's start."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, w = with_next(base, "doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    rows = add_sketch(add_sketch(rows, "text", "own", k), "edited", "other", k)
    rows = rows.select("doc_id", "__aux", "__bucket", "__key", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "other")
    rows = rows.withColumn("next_sketch", F.lead("own").over(w)).filter(~F.col("__aux"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_text(F.col("own")).alias("fingerprint"),
        to_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"),
    )
