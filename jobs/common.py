"""What both jobs share: their small configuration files and their command lines."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def config(name: str, path: str | None = None) -> dict:
    """The job's own settings, changed by those of a file if one is given."""
    with open(os.path.join(HERE, f"{name}.json"), encoding="utf-8") as f:
        out = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        unknown = set(own) - set(out)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out |= own
    return out


def command(name: str, about: str, run: Callable[[SparkSession, str, str, dict], DataFrame], args: list[str] | None = None) -> None:
    """Read the arguments, make a session, run the job, stop the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    parser.add_argument("events", help="table of events (Parquet)")
    parser.add_argument("out", help="folder that the job writes to")
    parser.add_argument("--config", help="JSON file with settings that differ from the job's own")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, given.events, given.out, config(name, given.config))
    finally:
        spark.stop()
