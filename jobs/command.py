"""The command line that the jobs share: a configuration file, flags for each of its keys, a session for the run."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

from pagelode import reach_workers


def settings(args: list[str] | None, defaults: dict, about: str) -> dict:
    """defaults, over them the JSON object in --config, over that the flags. Keys that are not among the defaults raise ValueError."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="JSON file with any of the other settings")
    for key, value in defaults.items():
        parser.add_argument(f"--{key.replace('_', '-')}", dest=key, type=int if isinstance(value, int) else str)
    flags = vars(parser.parse_args(args))
    path, own = flags.pop("config"), {}
    if path:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
    if unknown := sorted(set(own) - set(defaults)):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    out = defaults | own | {k: v for k, v in flags.items() if v is not None}
    if missing := [k for k, v in out.items() if v == ""]:
        raise ValueError(f"no value for: {', '.join(missing)}")
    return out


def main(name: str, run: Callable, defaults: dict, about: str, args: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    own = settings(args, defaults, about)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        reach_workers(spark)
        run(spark, **own)
    finally:
        spark.stop()
