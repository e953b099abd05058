"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with what a JSON file says; read by Spark, so the path may be in any store. An unknown name is an error."""
    told = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    unknown = set(told) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | told


def command(name: str, paths: dict[str, str], run) -> None:
    """Parses the paths and --config, makes a session, runs, and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for option, text in paths.items():
        parser.add_argument(f"--{option}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of settings; the defaults stand in the module")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *(given[p] for p in paths), config=given["config"])
    finally:
        spark.stop()
