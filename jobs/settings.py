"""What the jobs' command lines share: settings from a TOML file, overridden by arguments, and logging."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def main(job: str, run: Callable, doc: str | None) -> None:
    """Runs a job from the command line: --config FILE, and --NAME VALUE for each of its settings."""
    default = Path(__file__).parent / f"{job}.toml"
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", type=Path, default=default)
    known, rest = first.parse_known_args()
    settings = tomllib.loads(known.config.read_text())
    parser = argparse.ArgumentParser(description=doc, parents=[first])
    for name, value in settings.items():
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name, type=type(value), default=value)
    given = vars(parser.parse_args(rest))
    given.pop("config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, **given)
    finally:
        spark.stop()
