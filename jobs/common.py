"""What both jobs share: the configuration, logs, a session for the command line."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("loomspan.jobs")


def command_line(description: str, *names: str) -> argparse.Namespace:
    """--config, and an option for each path; options win over the file."""
    ap = argparse.ArgumentParser(description=description)
    ap.add_argument("--config", required=True, help="a JSON file with one object; any path that Spark reads")
    for n in names:
        ap.add_argument(f"--{n}")
    return ap.parse_args()


def settings(spark: SparkSession, given: argparse.Namespace) -> dict[str, object]:
    """The configuration, overridden by what the command line names."""
    read = spark.read.option("multiLine", True).json(given.config).first().asDict(recursive=True)
    return read | {k: v for k, v in vars(given).items() if k != "config" and v is not None}


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and the number of its rows (`n`) once an action has run over it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen
