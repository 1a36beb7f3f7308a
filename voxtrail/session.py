"""Session settings and the shared folder for data that must outlive executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

PART_ROWS = 500_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("voxtrail")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that spark.checkpoint.dir names.

    Only where that is unset and Spark is local (tests, notebooks) is a folder of this machine used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="voxtrail-"))
    return context.getCheckpointDir()


def pin(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes `df` to the shared folder and cuts its lineage.

    With `rows`, a bound of its rows, it is written in parts of about PART_ROWS rows: many
    tiny files cost a store more than their rows do.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // PART_ROWS)))).checkpoint(eager=True)
