import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pagelode.llm import recompress, repeats, suffix_dedup
from pagelode.llm.common import texts_as_bytes

from .util import brute_bytes, brute_words, hard_texts, table


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_bytes_against_brute_force(spark):
    texts = hard_texts()
    docs = table(spark, texts).repartition(3)
    got = rows_of(suffix_dedup.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute_bytes(list(enumerate(texts))))


def test_bytes_ids_that_fall_repeat_or_are_null(spark):
    texts = ["x" * 20 + "0123456789" * 8, "0123456789" * 9, "0123456789" * 9, "0123456789" * 6]
    docs = table(spark, texts, ids=[9, 3, 3, None])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digests(docs).collect()}
    assert got[9] == (100, 80) and got[3] == (90, 0) and got[None] == (60, 60)


def test_words_against_brute_force(spark):
    texts = hard_texts(6)
    docs = table(spark, texts).repartition(3)
    got = rows_of(recompress.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute_words(list(enumerate(texts))))


@pytest.mark.parametrize("seed", range(3))
def test_words_random(spark, seed):
    r = random.Random(seed)
    texts = []
    for _ in range(12):
        w = []
        for _ in range(r.randrange(1, 8)):
            if r.random() < 0.5 and texts:
                s = r.choice(texts).split()
                a = r.randrange(len(s) + 1)
                w += s[a : a + r.randrange(80)]
            elif r.random() < 0.3:
                w += ["r%d" % r.randrange(2)] * r.randrange(50)
            else:
                w += ["v%d" % r.randrange(50) for _ in range(r.randrange(40))]
        texts.append(" ".join(w))
    got = rows_of(recompress.digests(table(spark, texts), 12), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute_words(list(enumerate(texts)), 12))


def test_suffix_sort_orders_and_verifies():
    r = random.Random(1)
    raw = np.frombuffer(bytes(r.choice(b"ab") for _ in range(3000)), np.uint8)
    at = np.array(r.sample(range(2900), 700))
    segment = np.sort(np.array([r.randrange(4) for _ in at]))
    order = suffix_dedup.SuffixSorter(raw, 50).sort(at, segment)
    text = bytes(raw) + bytes(50)
    expect = sorted(range(len(at)), key=lambda i: (segment[i], text[at[i] : at[i] + 50], i))
    assert order.tolist() == expect


def test_empty_table_and_clashing_names(spark):
    empty = table(spark, []).withColumnRenamed("source", "row_key")
    assert suffix_dedup.digests(empty).count() == 0 and recompress.digests(empty).count() == 0
    docs = table(spark, hard_texts()).withColumnRenamed("source", "row_key").withColumnRenamed("lang", "ranges")
    out = recompress.deduplicated(docs)
    assert out.schema == docs.schema
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[0] is None and kept[3] == "one" and 6 not in kept


def test_equal_results_for_other_partitions(spark):
    docs = table(spark, hard_texts())
    one = rows_of(suffix_dedup.digests(docs.coalesce(1)), "doc_id", "kept_sha256")
    assert one == rows_of(suffix_dedup.digests(docs.repartition(7)), "doc_id", "kept_sha256")


def in_process(texts, stages_of, folder, block_text=2000, seed=0):
    """Runs stages as Spark would, here: (rows of a block, its last rows) of all blocks. What a target gets comes in any order."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    rows = [(t, repeats.FILES, x) for out in repeats.stored(folder, block_text)([batch]) for t, x in zip(out["target"].to_pylist(), out["blob"].to_pylist())]
    r = random.Random(seed)

    def by_target():
        r.shuffle(rows)
        return sorted(rows, key=lambda x: x[:2])

    for stage in stages_of:
        rows = [row for out in stage([repeats.blob_batch(by_target())]) for row in zip(*(c.to_pylist() for c in out.columns))]
    return [(repeats.rows_of(repeats.own_files(held)), held) for _, held in repeats.by_target([repeats.blob_batch(by_target())])]


def words_here(texts, folder, window, buckets=3, **more):
    out = []
    for batch, held in in_process(texts, recompress.stages(window, recompress.ROUNDS, buckets, folder), folder, **more):
        ranges = recompress._block_ranges(held, window)
        for i, t in enumerate(texts_as_bytes(batch["text"])):
            kept, gone = recompress.without(t, ranges.get(i))
            out.append((batch["doc_id"][i].as_py(), len(kept) + gone, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def bytes_here(texts, folder, buckets=3, **more):
    length, k = suffix_dedup.LENGTH, suffix_dedup.K
    out = []
    for batch, held in in_process(texts, suffix_dedup.stages(length, k, buckets, folder), folder, **more):
        ranges = suffix_dedup._block_ranges(held, batch["doc_id"].to_numpy(), length)
        for i, t in enumerate(texts_as_bytes(batch["text"])):
            kept, spans = suffix_dedup.without(t, ranges.get(i))
            out.append((batch["doc_id"][i].as_py(), len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def small_texts(seed):
    r = random.Random(seed)
    texts = [None, "", "one"]
    for _ in range(25):
        w = []
        for _ in range(r.randrange(1, 8)):
            if r.random() < 0.5:
                s = (r.choice(texts) or "").split()
                a = r.randrange(len(s) + 1)
                w += s[a : a + r.randrange(60)]
            elif r.random() < 0.3:
                w += r.sample(["x", "y"], r.randrange(1, 3)) * r.randrange(40)
            else:
                w += ["v%d" % r.randrange(30) for _ in range(r.randrange(40))]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("block_text", [1, 300, 5000])
@pytest.mark.parametrize("seed", range(4))
def test_words_over_many_blocks(tmp_path, seed, block_text):
    texts = small_texts(seed)
    assert words_here(texts, str(tmp_path), 12, block_text=block_text, seed=seed) == sorted(brute_words(list(enumerate(texts)), 12))


@pytest.mark.parametrize("block_text", [1, 300, 5000])
@pytest.mark.parametrize("seed", range(3))
def test_bytes_over_many_blocks(tmp_path, seed, block_text):
    texts = small_texts(seed)
    assert bytes_here(texts, str(tmp_path), block_text=block_text, seed=seed) == sorted(brute_bytes(list(enumerate(texts))))


@pytest.mark.parametrize("hot", [3, 4096])
@pytest.mark.parametrize("few", [1, 2, 16])
def test_colliding_names_join_nothing(tmp_path, monkeypatch, few, hot):
    """Where all symbols, anchors and windows have one of a few names, words decide."""
    monkeypatch.setattr(repeats, "HOT", hot)
    real = recompress._named
    monkeypatch.setattr(recompress, "_named", lambda x: real(x) % np.uint64(few))
    texts = small_texts(7)
    assert words_here(texts, str(tmp_path), 12) == sorted(brute_words(list(enumerate(texts)), 12))


def test_rounds_leave_little_to_compare(tmp_path):
    r = random.Random(4)
    words = lambda n: " ".join("v%d" % r.randrange(200) for _ in range(n))
    passage = words(60)
    texts = [f"{words(400)} {passage if n % 5 == 0 else ''} {words(400)}" for n in range(40)]
    own = repeats.rows_of(next(repeats.stored(str(tmp_path))([pa.RecordBatch.from_pydict({"text": texts})]))["blob"][0].as_py())
    parts = [recompress.Parsed(raw, offs, 35) for _, raw, offs in repeats.sub_blocks(own)]
    left = []
    for n in range(recompress.ROUNDS + 1):
        left.append(sum(len(p.alive()) for p in parts))
        if n < recompress.ROUNDS:
            names = [p.offered(n + 1) for p in parts]
            found = np.isin(np.concatenate(names), [x for x, c in zip(*np.unique(np.concatenate(names), return_counts=True)) if c > 1])
            for p, own in zip(parts, names):
                p.learn(n + 1, found[: len(own)])
                found = found[len(own) :]
    assert left[0] > left[1] >= left[2] >= left[3] and left[3] < 8 * 30 * 2


def test_the_suffix_order_decides(monkeypatch):
    """With another comparison than that of the suffixes, equal windows aren't neighbours and the result is another."""
    r = random.Random(3)
    part = lambda n: bytes(r.choice(b"abcd") for _ in range(n))
    anchor = part(20)
    left = [part(15) for _ in range(6)]
    texts = [left[k % 6] + anchor + part(15) for k in range(60)]
    texts = [texts[r.randrange(30)] if n % 2 else t for n, t in enumerate(texts)]
    texts = [t[:n] + t[n:] for n, t in enumerate(texts)]
    rows = np.zeros(len(texts), suffix_dedup._HEAD)
    rows["anchor"], rows["doc"], rows["at"], rows["left"], rows["windows"] = 7, np.arange(len(texts))[::-1], np.arange(len(texts)), 15, 1
    shapes = np.array([n % 2 for n in range(len(texts))])  # some stretches have one more byte, so that equal windows stand in unequal stretches
    texts = [t + (b"z" if s else b"") for t, s in zip(texts, shapes)]
    rows["windows"] += shapes.astype("u1")
    least = {}
    for row, t in zip(rows, texts):
        least[t[:50]] = min(least.get(t[:50], 1 << 60), int(row["doc"]))

    def got():
        first, kind, found = suffix_dedup.smallest_documents(rows, np.frombuffer(b"".join(texts), np.uint8), 50)
        return [int(found[first[k]]) for k in kind]

    assert got() == [least[t[:50]] for t in texts]
    monkeypatch.setattr(suffix_dedup.SuffixSorter, "less", lambda self, a, b, or_equal: or_equal)
    assert got() != [least[t[:50]] for t in texts]


@pytest.mark.parametrize("hot", [0, 2, 5])
@pytest.mark.parametrize("seed", range(2))
def test_bytes_with_hot_anchors(tmp_path, monkeypatch, seed, hot):
    """However many anchors are hot: their windows are looked at one by one."""
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(seed)
    passage = "a passage that a part of all documents hold, with other words around it each time"
    texts = small_texts(seed) + [" ".join("w%d" % r.randrange(50) for _ in range(6)) + " " + passage + " " + " ".join("w%d" % r.randrange(50) for _ in range(6)) for _ in range(20)]
    assert bytes_here(texts, str(tmp_path), block_text=600, seed=seed) == sorted(brute_bytes(list(enumerate(texts))))


@pytest.mark.parametrize("hot", [0, 2, 5])
@pytest.mark.parametrize("seed", range(3))
def test_words_with_hot_anchors(tmp_path, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(seed)
    passage = " ".join("p%d" % i for i in range(15))
    texts = small_texts(seed) + [" ".join("w%d" % r.randrange(4) for _ in range(8)) + " " + passage + " " + " ".join("w%d" % r.randrange(4) for _ in range(8)) for _ in range(25)]
    assert words_here(texts, str(tmp_path), 12, block_text=600, seed=seed) == sorted(brute_words(list(enumerate(texts)), 12))


def test_a_hot_passage_sends_few_windows(tmp_path, monkeypatch):
    """The borders of a passage in many documents aren't sent whole: their windows differ, and only what is met elsewhere goes."""
    sent = []
    real = recompress._Pieces.sent
    monkeypatch.setattr(recompress._Pieces, "sent", lambda self, block, which, buckets: sent.append(len(which)) or real(self, block, which, buckets))
    passage = " ".join("p%d" % i for i in range(30))
    texts = [" ".join(f"a{n}x{i}" for i in range(30)) + " " + passage + " " + " ".join(f"b{n}x{i}" for i in range(30)) for n in range(300)]
    expect = sorted(brute_words(list(enumerate(texts)), 12))
    for hot in (10_000, 50):
        monkeypatch.setattr(repeats, "HOT", hot)
        sent.clear()
        assert words_here(texts, str(tmp_path), 12, block_text=20_000) == expect
        n = sum(sent)
        whole = n if hot == 10_000 else whole
    assert n < whole / 2
