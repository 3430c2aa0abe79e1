"""A semantic page index on Spark: crawl, extract, chunk, embed, store and search web pages."""

from __future__ import annotations

import os

__version__ = "0.1.0"


def reach_workers(spark) -> None:
    """Lets Python workers import this package from where the driver has it, whatever their working folder.

    On a cluster without that folder, ship the package with --py-files as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
