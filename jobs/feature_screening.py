"""Screens measurements against labels: which of them tells labelled rows apart, in each group of rows.

    python jobs/feature_screening.py --config jobs/feature_screening.toml

Measures every labelled text, then gives for each language, label and measurement the area under the rank curve
(the share of pairs of a labelled and an unlabelled row that the measurement puts in order) and the medians of both
sides.  OUT is partitioned by label and language; a rerun replaces the partitions that it computes and leaves
others, so the same tables give the same result.

Texts that are null are empty; a row whose label is null is left out for that label; a document with several rows of labels
counts once for each; documents without a language form a group of their own.  Labels are joined to
numbers, not to texts, so texts are never shuffled.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from voxtrail.functions.windows import quantiles
from voxtrail.operators import sweeps

log = logging.getLogger("feature_screening")
LABELS = ("quality", "toxic")
SCREEN = "feature string, n long, n_positive long, auc double, median_positive double, median_negative double, label string, lang string"
_WORD = r"[^\x20\x09-\x0D]+"


def measurements(text: Column) -> dict[str, Column]:
    """Whole numbers that describe a text; shares are in thousandths of its characters, word length in hundredths."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    chars, words = F.length(text).cast("long"), count(_WORD)
    share = lambda n: F.floor(n * 1000 / F.greatest(chars, F.lit(1)))
    spaces = count(r"[\x20\x09-\x0D]")
    return {
        "characters": chars,
        "words": words,
        "lines": count(r"\n"),
        "digits": share(count("[0-9]")),
        "capitals": share(count("[A-Z]")),
        "marks": share(count(r"[!-/:-@\[-`{-~]")),
        "spaces": share(spaces),
        "word_length": F.floor((chars - spaces) * 100 / F.greatest(words, F.lit(1))),
    }


def screen(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (SCREEN) for every language, label and measurement."""
    named = measurements(F.coalesce(F.col("text"), F.lit("")))
    rows = documents.select("doc_id", F.nullif(F.col("lang"), F.lit("")).alias("lang"), *[c.alias(n) for n, c in named.items()])
    rows = rows.join(labels.select("doc_id", *LABELS), "doc_id")
    marks = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("mark")) for x in LABELS]))
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in named]))
    rows = rows.withColumn("l", marks).filter("l.mark is not null").withColumn("m", values)
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # keys that joins find again, null or not
    rows = rows.select(group.alias("of"), "l.label", "m.feature", "m.value", (F.col("l.mark") == 1).alias("positive"))
    rows = rows.groupBy("of", "label", "feature", "value", "positive").agg(F.count(F.lit(1)).alias("times"))
    key = ["label", "of", "feature"]
    sides = quantiles(rows, "value", [*key, "positive"], [0.5], times="times").groupBy(*key).agg(
        F.max(F.when(F.col("positive"), F.col("__p")[0])).alias("median_positive"), F.max(F.when(~F.col("positive"), F.col("__p")[0])).alias("median_negative")
    )
    out = sweeps.rank_auc(rows, "value", "positive", key, times="times").withColumnRenamed("p", "n_positive").join(sides, key)
    return out.withColumn("lang", F.when(F.col("of") != "", F.substring("of", 2, 1 << 30))).select(*[c.split()[0] for c in SCREEN.split(", ")])


def run(spark: SparkSession, documents: str, labels: str, out: str) -> DataFrame:
    """Screens the tables' rows and returns the output, read back."""
    docs, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    rows = screen(docs, marks).repartition("label", "lang")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "lang").parquet(out)
    written = spark.read.schema(SCREEN).parquet(out)
    log.info("read %d documents of %s and %d labels of %s; %s has %d rows", docs.count(), documents, marks.count(), labels, out, written.count())
    return written


if __name__ == "__main__":
    from jobs.settings import main

    main("feature_screening", run, __doc__)
