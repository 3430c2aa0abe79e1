import numpy as np
import pytest

from pagelode.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def table(spark, ids, vectors, schema=SCHEMA):
    rows = [(None if i is None else int(i), None if x is None else [None if c is None else float(c) for c in x], 1, 7, "clash") for i, x in zip(ids, vectors)]
    return spark.createDataFrame(rows, schema)


def brute(ids, x, k=20, every=20):
    """query -> [(score, id)], nearest first"""
    x = np.asarray(x, np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(np.asarray(ids) % every == 0):
        s = ann.exact(np.broadcast_to(x[q], x.shape), x)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [(float(s[i]), int(ids[i])) for i in order]
    return out


def got(spark, df, **more):
    out = {}
    for r in sorted(ann.neighbours(df, **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        own.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(own)
    return out


def compared(found, expected, at_least=0.9):
    """Recall; and what is found is in order, with exact scores."""
    hit = total = 0
    scores = {q: dict((i, s) for s, i in e) for q, e in expected.items()}
    for q, e in expected.items():
        own = found.get(q, [])
        assert own == sorted(own, key=lambda x: (-x[0], x[1])) and len({i for _, i in own}) == len(own) and q not in {i for _, i in own}
        assert all(scores[q][i] == s for s, i in own if i in scores[q])
        hit += len({i for _, i in own} & set(scores[q]))
        total += len(e)
    assert set(found) <= set(expected) and hit >= at_least * total, hit / total
    return hit / total


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["uniform", "clustered", "norms", "outlier"])
def test_recall(spark, kind):
    r = np.random.default_rng(4)
    n, d = 6000, 24
    x = unit(r.standard_normal((n, d)))
    if kind == "clustered":
        x = unit(r.standard_normal((40, d))[r.integers(0, 40, n)] + 0.3 * r.standard_normal((n, d)))
    if kind == "norms":
        x = x * r.lognormal(0, 0.7, (n, 1))
    if kind == "outlier":
        x[17] *= 1000
    ids = np.arange(n)
    compared(got(spark, table(spark, ids, x)), brute(ids, x))


def test_every_part_and_group_is_met(spark):
    r = np.random.default_rng(5)
    x, ids = unit(r.standard_normal((5000, 16))), r.permutation(5000)
    compared(got(spark, table(spark, ids, x), chunk_bytes=50_000, tables=3), brute(ids, x))


def test_query_reaches_its_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    compared(got(spark, df), brute(np.array([r["vec_id"] for r in rows]), [r["embedding"] for r in rows]))


def test_large_groups_of_copies_and_ties(spark):
    r = np.random.default_rng(6)
    x = r.integers(-2, 3, (3000, 6)).astype(float)  # whole numbers: many equal products
    x[(x == 0).all(axis=1), 0] = 1
    x[r.random(3000) < 0.4] = [1, 2, -1, 0, 1, 1]
    ids = r.permutation(3000) - 1000
    assert compared(got(spark, table(spark, ids, x)), brute(ids, x)) > 0.97


def test_few_vectors_are_compared_with_all(spark):
    r = np.random.default_rng(7)
    x, ids = r.standard_normal((30, 5)), np.arange(-10, 20)
    assert got(spark, table(spark, ids, x)) == brute(ids, x)
    assert got(spark, table(spark, [20], [[1.0, 2.0]])) == {} and got(spark, table(spark, [1, 2], [[1.0], [2.0]])) == {}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    ids = [0, 1, 2, 3, 20, 40, 60, 80, 100, None, 5, 7]
    vectors = [[1, 1], [1, 0.5], [0, 2], [nan, 1], [inf, 1], [0, 0], None, [], [1, None], [9, 9], [1, 2, 3], [-1, 0]]
    assert got(spark, table(spark, ids, vectors)) == {0: [(2.0, 2), (1.5, 1), (-1.0, 7)]}


def test_repeated_ids(spark):
    ids, x = [0, 0, 1, 1, 2, 2], [[1, 0], [2, 0], [3, 0], [-3, 0], [1, 1], [1, 1]]
    assert got(spark, table(spark, ids, x)) == {0: [(3.0, 1), (1.0, 2)]}


def test_an_empty_table_and_doubles(spark):
    assert got(spark, table(spark, [], [])) == {}
    df = table(spark, [0, 1], [[1, 2], [3, 4]], SCHEMA.replace("float", "double"))
    assert got(spark, df) == {0: [(11.0, 1)]}
