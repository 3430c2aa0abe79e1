import os

import pytest

from pagelode.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_statement(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    names = [x[0] for x in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in mine.select(*names).collect()) == sorted(map(repr, theirs.fetchall()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13))


def test_shards_of_the_table(spark):
    rows = QUERIES["op10_sharding"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(os.path.join(SF, "documents.parquet")).count()
    assert {r["law"] for r in rows} == {"bytes"} and {r["shard"] for r in rows} == set(range(16)) and all(r["grown_shard"] is None for r in rows)
    load = {}
    for r in rows:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
