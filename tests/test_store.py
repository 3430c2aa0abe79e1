"""The vector index, and what a search on the stored table reads."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.operators import search, vector_index
from pagelode.operators.store import ChunkStore, _tables, materialised, passing
from pagelode.operators.vector_index import VectorIndex
from pagelode.plans import tools

DAY = lambda n: datetime.datetime(2024, 1, n, 12)


def vectors(n=4000, d=16, seed=1, clusters=30):
    r = np.random.default_rng(seed)
    x = r.standard_normal((clusters, d))[r.integers(0, clusters, n)] + 0.4 * r.standard_normal((n, d))
    return x.astype(np.float32)


def frame(spark, x, ids=None, kind="long"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v], "own") for i, v in zip(ids, x)], f"vec_id {kind}, embedding array<float>, label string")


def brute(x, q, k, ids):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ (q / np.linalg.norm(q))
    return [ids[i] for i in np.lexsort((ids, -np.round(s, 12)))[:k]]


def files_read(df):
    """How many files the scans of a query have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.getClass().getSimpleName() else leaf
        if leaf.metrics().contains("numFiles"):
            total += leaf.metrics().apply("numFiles").value()
    return total


def test_index_recall_and_exactness(spark, tmp_path):
    x = vectors()
    index = VectorIndex.build(frame(spark, x), str(tmp_path / "ix"), "vec_id", cell_rows=64, part_rows=50)
    assert len(index._read()["parts"]) == 62 and max(index._read()["parts"]) > 1 and index.probes < 40
    queries = frame(spark, x[::20], range(0, 4000, 20)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    true = {q: brute(x, x[q].astype(float), 10, np.arange(4000)) for q in range(0, 4000, 20)}
    hits = 0
    for probes in (None, 0):
        got = {}
        for r in index.search_batch(queries, 10, probes=probes).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        if probes is None:
            assert got == true
        hits = sum(len(set(got[q]) & set(true[q])) for q in true)
    assert hits >= 0.9 * 2000
    one = search.top_k(index.near(x[7]), x[7], 5, None, tie="id", vector="v").collect()
    assert [r["id"] for r in one][0] == 7
    every = search.top_k(index.near(x[7], probes=None), x[7], 5, None, tie="id", vector="v").collect()
    assert [r["id"] for r in every] == true.get(7, brute(x, x[7].astype(float), 5, np.arange(4000)))
    assert files_read(index.near(x[7], probes=3)) < 0.25 * files_read(index.vectors())


def test_index_of_hard_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0], [1, 0], [1, 0], None, [], [0, 0], [nan, 1], [inf, 1], [1, 2, 3], [-1, 0], [0, 1]]
    index = VectorIndex.build(frame(spark, x, list("abcdefghijk"), "string"), str(tmp_path / "ix"), "vec_id", cells=2, part_rows=1)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.0, 1.0])], "query_id int, v array<double>")
    got = [(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in index.search_batch(asked, 3, probes=None).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", 1.0, 1), (1, "b", 1.0, 2), (1, "c", 1.0, 3), (5, "k", 1.0, 1), (5, "a", 0.0, 2), (5, "b", 0.0, 3)]


def test_index_of_an_empty_table(spark, tmp_path):
    index = VectorIndex.build(frame(spark, []), str(tmp_path / "ix"), "vec_id")
    assert index.near([1.0]).count() == 0


def rows_of(spark, x, day, first=0):
    rows = [(f"p{i}", f"http://h/{i}", f"t{i}", "", 0, f"text {i}", "", "", day, f"c{i}-{day}", [float(c) for c in v]) for i, v in enumerate(x, first)]
    from pagelode.operators.store import CHUNKS

    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture
def store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s", 16, buckets=4)
    store.ensure()
    x = vectors(600)
    for n in range(6):
        store.replace_pages(rows_of(spark, x[100 * n : 100 * n + 100], DAY(1 + 3 * n), 100 * n))
    return store, x


def urls(df):
    return [r["url"] for r in df.orderBy(F.desc("score"), "point_id").collect()]


def test_search_reads_the_days_it_asks_for(spark, store):
    store, x = store
    as_of, q = DAY(17), x[3].tolist()
    plain = search.search(store.chunks(), q, 5, 6, as_of, -1.0)
    pruned = search.search_store(store, q, 5, 6, as_of, -1.0)
    assert urls(pruned) == urls(plain) and len(urls(plain)) == 5
    assert files_read(pruned) <= 0.55 * files_read(plain)
    old = store.chunks(before=DAY(5))
    assert {r["url"] for r in old.collect()} == {f"http://h/{i}" for i in range(200)} and files_read(old) <= 0.55 * files_read(store.chunks())
    assert store.chunks().columns == store.near(q).columns


def test_an_index_serves_later_versions(spark, store):
    store, x = store
    assert store.build_index(cells=20) == store.versions()[-1] and store.indexes() == store.versions()[-1:]
    q = x[250].tolist()
    exact = urls(search.top_k(store.chunks(), q, 5, None))
    assert urls(search.search_store(store, q, threshold=-1.0, probes=None)) == exact
    assert urls(search.search_store(store, q, threshold=-1.0))[0] == "http://h/250"
    # one page is replaced by one that is nearest, another loses its chunks: their buckets are scanned
    store.replace_pages(rows_of(spark, [x[250]], DAY(20), 7), changed=spark.createDataFrame([("http://h/250", "x"), ("http://h/7", "y")], "url string, content_hash string"))
    assert urls(search.search_store(store, q, threshold=-1.0))[0] == "http://h/7"
    found = urls(search.search_store(store, q, limit=1000, threshold=-1.0, probes=None))
    assert sorted(found) == sorted(r["url"] for r in store.chunks().collect()) and "http://h/250" not in found
    assert urls(search.search_store(store, q, 5, 10, DAY(20), -1.0, probes=None)) == urls(search.search(store.chunks(), q, 5, 10, DAY(20), -1.0))
    store.vacuum(1)
    assert urls(search.search_store(store, q, threshold=-1.0))[0] == "http://h/7" and len(store.versions()) == 2


def test_list_urls_by_pages(spark, store):
    store, _ = store
    from pagelode.operators.embed import HashProvider

    own = tools.Tools(store, HashProvider(16), as_of=DAY(17))
    seen, after = [], ""
    while True:
        lines = own.list_urls(limit=250, after=after).split("\n")
        seen += [x.split(" | ")[0][2:] for x in lines if x.startswith("- ")]
        if not lines[-1].startswith("More pages after: "):
            break
        after = lines[-1].removeprefix("More pages after: ")
    assert len(seen) == 600 and len(set(seen)) == 600 and seen[0] == "http://h/0"
    assert own.list_urls(stale_days=14).startswith("100 pages:") and own.list_urls(stale_days=400) == "No pages are older than 400 days."


def test_tables_in_between_are_deleted(spark):
    with passing(spark):
        df = materialised(spark.range(3))
        assert df.count() == 3 and _tables
        path = _tables[-1]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert path not in _tables


def test_search_in_groups_of_cells(spark, tmp_path):
    """Cells of one part stand together, large ones in parts; a third of the vectors are one."""
    x = vectors(1500, clusters=12)
    x[::3] = x[0]
    index = VectorIndex.build(frame(spark, x), str(tmp_path / "ix"), "vec_id", cells=40, part_rows=120)
    assert max(index._read()["parts"]) > 1 and min(index._read()["parts"]) == 1
    queries = frame(spark, x[::7], range(0, 1500, 7)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    cell = {r["id"]: r["cell"] for r in index.vectors().select("id", "cell").collect()}
    centroids, place = index._read()["centroids"], np.array([cell[i] for i in range(1500)])
    near = np.argsort(-(x[::7].astype(float) @ centroids.T), axis=1, kind="stable")
    for probes, group_rows in ((None, 200), (None, 10_000), (1, 300), (7, 300), (7, 10_000), (40, 1)):
        got = {}
        for r in index.search_batch(queries, 10, probes, group_rows).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        for i, q in enumerate(range(0, 1500, 7)):
            own = np.arange(1500) if probes is None else np.flatnonzero(np.isin(place, near[i, :probes]))
            assert got[q] == brute(x[own], x[q].astype(float), 10, own), (probes, group_rows, q)


def test_a_query_goes_to_a_group_of_cells_once(spark, tmp_path, monkeypatch):
    """What meets doesn't grow with queries times cells."""
    x = vectors(600)
    index = VectorIndex.build(frame(spark, x), str(tmp_path / "ix"), "vec_id", cells=100)
    queries = frame(spark, x).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    sent = []
    monkeypatch.setattr(vector_index, "nearest_in_parts", lambda held, asking, *a: sent.append((held.count(), asking.count())))
    for probes in (None, 90):
        index.search_batch(queries, 3, probes)
    assert sent == [(600, 600)] * 2
