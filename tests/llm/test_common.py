"""The join whose hot keys are dealt to parts, against plain joins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelode.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1, 5, 100_000])
def test_met_equals_a_join(spark, monkeypatch, how, hot_rows):
    """Keys of one row and of a third of all, keys that either side lacks, null keys, repeated rows; counts that are exact, too high or absent."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    keys = [7] * 200 + [3] * 90 + list(range(100, 300)) + [None] * 60
    rows = spark.createDataFrame([(k, i // 2) for i, k in enumerate(keys)], "k long, i long")
    table = spark.createDataFrame([(k, f"t{k}") for k in (7, 3, 999, None, *range(150, 400))], "k long, t string")
    counts = rows.where("k IS NOT NULL").groupBy("k").agg((F.count("*") + F.col("k") % 3).alias("n")).where("n > 1")
    want = sorted(map(repr, rows.join(table, "k", how).collect()))
    assert sorted(map(repr, common.met(rows, table, "k", counts, "n", "i", how).collect())) == want
    assert sorted(map(repr, common.met(rows, table, "k", counts.limit(0), "n", "i", how).collect())) == want


def test_a_hot_key_is_in_many_tasks(spark):
    rows = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "-1", "64")):
            spark.conf.set(k, v)
        got = common.met(rows, counts, "k", counts, "n", "id").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows"), F.count_if(F.col("k") == -1).alias("hot")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["rows"] for r in got) == 30_000 and sum(r["hot"] for r in got) == 10_000
    assert max(r["rows"] for r in got) < 2_000


def test_no_rows(spark):
    rows = spark.createDataFrame([], "k long, i long")
    counts = spark.createDataFrame([], "k long, n long")
    assert common.met(rows, counts, "k", counts, "n", "i", "left").count() == 0
