"""Every stage of the pipeline against a brute-force version of what it says it does, each on the rows its predecessor kept."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from pagelode.llm import bpe, quality

from .test_rules import brute_hits
from .util import SCHEMA, WORD, brute_near, hard_texts

BENCH = [(1, "What is the height of the tallest tower that was built in the old town before the war"), (2, "two words")]


def rows_for_pipeline():
    r = random.Random(9)
    words = lambda n: " ".join("v%d" % r.randrange(3000) for _ in range(n))
    passage = words(60)
    texts = list(hard_texts(9))
    texts += [words(80) + "\n" + passage + "\n" + words(70) for _ in range(3)]
    texts += [words(90) + " " + BENCH[0][1] + ", " + words(60), words(70) + ". Two words! " + words(30)]
    base = words(200).split()
    for k in range(5):
        near = list(base)
        near[10 + k] = "other%d" % k
        texts.append(" ".join(near))
    texts += [words(100) + "\nall rights reserved by the owners of this site" for _ in range(14)]
    return [(100 + i, t, "en", "s0", None if t is None else len(t)) for i, t in enumerate(texts)]


def as_rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def brute_quality(rows):
    lines = {i: [(s, " ".join(x.split()).lower(), x) for x in (t or "").split("\n") if x.split()] for i, t, _, s, _ in rows}
    docs = {}
    for i, own in lines.items():
        for s, k, _ in own:
            docs.setdefault((s, k), set()).add(i)
    frequent = {k for k, v in docs.items() if len(v) > quality.MAX_DOCS}
    total = {i: sum(len(x.split()) for _, _, x in own) for i, own in lines.items()}
    share = {i: sum(len(x.split()) for s, k, x in own if (s, k) in frequent) for i, own in lines.items()}
    # a line counts once for documents with the same lines, and for near copies among those that are mostly frequent lines
    mostly = {i for i in lines if share[i] and 2 * share[i] > total[i]}
    kinds = {i: frozenset((s, k) for s, k, _ in lines[i]) for i in lines}
    first = {}
    for i in sorted(lines):
        first.setdefault(kinds[i], i)
    near = brute_near([(first[kinds[i]], next(t for j, t, *_ in rows if j == first[kinds[i]])) for i in sorted(mostly)], quality.COPY_WORDS, quality.COPY_PERCENT)
    group = {i: near[first[kinds[i]]][1] if i in mostly else first[kinds[i]] for i in lines}
    boiler = {k for k in frequent if len({group[i] for i in docs[k]}) > quality.MAX_DOCS}
    out = {}
    for i, t, _, s, _ in rows:
        w = (t or "").split()
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        count = Counter(grams)
        rep = {p for j, g in enumerate(grams) if count[g] > 1 for p in range(j, j + 3)}
        if len(w) < 50 or 100 * len(rep) > 50 * len(w):
            continue
        left = [x for x in (t or "").split("\n") if not x.split() or (s, " ".join(x.split()).lower()) not in boiler]
        if 2 * sum(len(x.split()) for x in left) >= len(w):
            out[i] = "\n".join(left)
    return out


def test_stages(spark, tmp_path):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = rows_for_pipeline()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "byte_bpe"]
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert out.schema == before.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            found[name] = as_rows(docs)

    one = found["quality_rules"]
    assert one == brute_quality(rows) and not any("all rights reserved" in t for t in one.values())

    near = brute_near(sorted(one.items()), 5)
    two = found["near_duplicates"]
    assert two == {i: t for i, t in one.items() if near[i][1] == i} and len(two) < len(one)

    three, counts = found["substring_dedup"], {}
    words = {i: WORD.findall(t) for i, t in two.items()}
    for w in words.values():
        for j in range(len(w) - 34):
            counts[tuple(w[j : j + 35])] = counts.get(tuple(w[j : j + 35]), 0) + 1
    kept = {}
    for i, w in words.items():
        gone = {p for j in range(len(w) - 34) if counts[tuple(w[j : j + 35])] > 1 for p in range(j, j + 35)}
        if len(gone) < len(w):
            kept[i] = [x for p, x in enumerate(w) if p not in gone]
    assert {i: WORD.findall(t) for i, t in three.items()} == kept and any(len(kept[i]) < len(words[i]) for i in kept)

    four = found["decontamination"]
    items = [(str(k), x) for k, x in BENCH]
    hit = {i for i, t in three.items() if brute_hits(t, items)[1]}
    assert len(hit) == 2 and set(four) == set(three)
    assert all(four[i] == three[i] for i in three if i not in hit) and not any(brute_hits(t, items)[1] for t in four.values())

    ranks = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).vocab.ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r["doc_id"]: r for r in docs.collect()}
    assert set(last) == set(four) and all(r["round_trip"] for r in last.values())
    assert all(np.array_equal(last[i]["token_ids"], library.encode_ordinary(t)) and last[i]["n_tokens"] == len(last[i]["token_ids"]) for i, t in four.items())

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["token_ids"] for r in whole.collect()} == {i: r["token_ids"] for i, r in last.items()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
