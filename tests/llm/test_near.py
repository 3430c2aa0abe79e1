import random

import numpy as np

from pagelode.llm import near_dedup

from .util import brute_near, hard_texts, table


def check(spark, texts, ids=None):
    docs = table(spark, texts, ids=ids)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.linked(docs).collect()}
    assert got == brute_near(list(zip(ids or range(len(texts)), texts)))


def test_against_brute_force(spark):
    check(spark, hard_texts())


def test_chains_around_the_threshold(spark):
    r = random.Random(3)
    base = ["b%d" % i for i in range(120)]
    texts = []
    for n in range(40):  # neighbours are linked, ends are not
        base = list(base)
        for _ in range(r.randrange(1, 4)):
            base[r.randrange(120)] = "c%d" % r.randrange(10_000)
        texts.append(" ".join(base))
    ids = list(range(40))
    r.shuffle(ids)
    check(spark, texts, ids)


def test_blocks_of_mixed_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near_dedup, "SALT_ROWS", 2)
    test_chains_around_the_threshold(spark)


def test_ids_by_join_when_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    check(spark, hard_texts())


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_EDGES", 0)
    test_chains_around_the_threshold(spark)


def brute_by_id(rows):
    """Ids as vertices: two are linked if any of their texts are; (component per id, size per row)"""
    near = brute_near(list(enumerate(t for _, t in rows)))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows):
            if near[a][1] == near[b][1]:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, near[k][0], find(i)) for k, (i, _) in enumerate(rows))


def test_repeated_and_null_ids(spark):
    t, other = "a b c d e f g h", "other words stand in this text"
    docs = table(spark, [t, t, other, t], ids=[5, 5, 5, None])
    rows = near_dedup.linked(docs).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [(5, 5, True)] * 3
    null = [r for r in rows if r["doc_id"] is None]
    assert len(null) == 1 and null[0]["kept"]
    out = near_dedup.deduplicated(docs)
    assert out.schema == docs.schema and sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, t), (5, t), (5, other)]


def test_an_id_joins_its_texts(spark):
    a, b, c = "a b c d e f g h", "i j k l m n o p", "q r s t u v w x"
    for rows in (
        [(1, a), (2, b), (3, a), (3, b)],
        [(4, a), (2, b), (3, a), (3, b), (9, c), (9, None), (7, None), (8, c), (3, "")],
        [(6, None), (6, c), (5, c), (6, a), (1, a), (2, None)],
    ):
        got = near_dedup.linked(table(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_by_id(rows)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_no_clean_text_goes(spark):
    a, b = "a b c d e f g h", "i j k l m n o p"
    rows = [(7, a), (7, b), (8, a), (9, None), (9, None), (9, ""), (10, b), (10, b)]
    docs = table(spark, [t for _, t in rows], ids=[i for i, _ in rows]).withColumnRenamed("lang", "kept_id").withColumnRenamed("source", "text_key")
    out = near_dedup.deduplicated(docs)
    assert out.schema == docs.schema
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(7, a), (7, b), (9, ""), (9, ""), (9, "")]


def test_recall_at_the_threshold():
    """Pairs at a similarity of exactly 0.8: all share a band, and none is put aside by the estimate."""
    r = np.random.default_rng(8)
    for both, own, pairs in ((8, 1, 6000), (40, 5, 3000), (400, 50, 1200)):
        agree = []
        for _ in range(pairs):
            pool = r.integers(0, 1 << 63, both + 2 * own).astype(np.uint64)
            x, y = near_dedup.sketch(pool[: both + own]), near_dedup.sketch(np.r_[pool[:both], pool[both + own :]])
            same = x == y
            agree.append(same.sum())
            assert same.reshape(near_dedup.BANDS, near_dedup.ROWS).all(axis=1).any()
            assert near_dedup._likely(x, both + own, y[None], np.array([both + own]), 80)[0] > 0
        assert abs(np.mean(agree) - 80) < 1 and abs(np.std(agree) - 4) < 0.6


def test_tables_in_between_can_be_cleared(spark):
    import os

    from pagelode.llm import common

    before = len(common._made)
    out = near_dedup.linked(table(spark, hard_texts()))
    n = out.count()
    assert n == len(hard_texts()) and len(common._made) > before
    kept = common.written(out, "kept")
    paths = [common.filesystem(p)[1] for p in common._made[before:]]
    assert common.clear(spark, before, (kept.work_path,)) == before + 1
    assert [os.path.exists(p) for p in paths] == [p == common.filesystem(kept.work_path)[1] for p in paths] and kept.count() == n


def test_empty(spark):
    assert near_dedup.linked(table(spark, [])).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:2200]), np.unique(pool[200:2400])
    x, y = near_dedup.sketch(a), near_dedup.sketch(b)
    assert (near_dedup.merge(x, y) == near_dedup.sketch(np.union1d(a, b))).all()
    more, less = np.array([(x > y).sum()]), np.array([(x < y).sum()])
    true = 2000 / 2400
    assert abs(near_dedup.likely_similarity(more, less, np.array([2200.0]), np.array([2200.0]))[0] - true) < 0.2
