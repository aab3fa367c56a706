"""What the jobs share: their config, their log, and tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def log_of(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_path(path: str) -> str:
    """The path as a pattern that only it matches, so that a file stream also takes a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def main(name: str, job: Callable[..., object], paths: dict[str, str]) -> None:
    """The command line: --config FILE (JSON: parameters, and paths if one likes), each path as an option of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=job.__doc__)
    parser.add_argument("--config", required=True, help="JSON file with the job's parameters")
    for p, text in paths.items():
        parser.add_argument(f"--{p}", help=text)
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(given.pop("config"), encoding="utf-8") as f:
        config = json.load(f)
    config |= {k: v for k, v in given.items() if v is not None}
    missing = [p for p in paths if not config.get(p)]
    if missing:
        parser.error(f"no path for {', '.join(missing)}")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        job(spark, **config)
    finally:
        spark.stop()
