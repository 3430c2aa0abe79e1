import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from pagelode.llm import bpe, token_files
from pagelode.llm.common import work_path

from .util import hard_texts, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, public_tokenizers.PATTERN)


def test_queries_decode_by_the_stream(spark, monkeypatch, codec):
    fed = []

    class Recorded(bpe.Utf8Stream):
        def feed(self, data):
            fed.append(data)
            return super().feed(data)

    monkeypatch.setattr(bpe, "Utf8Stream", Recorded)
    text = "naïve 中文 😀 " * 3000
    assert codec.decoded(codec.encode(text)) == text.encode() and len(fed) > 1

    class Plan:  # runs what a query hands to the workers here
        columns = ["doc_id", "text"]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})]))

    fed.clear()
    out = bpe.round_trips(Plan(), RANKS, public_tokenizers.PATTERN)
    assert out[0]["decoded_sha256"].to_pylist() == [hashlib.sha256(text.encode()).hexdigest()] and len(fed) > 1


def test_encode_as_the_library_does(codec):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocab.ranks, special_tokens={})
    r = random.Random(2)
    letters = "aab \n\t\x1c\x85 　éß中文😀'stllve0123½²!?{}()ſ<|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(2000)]
    texts += ["a" * 5000 + "ab" * 3000 + "the" * 2000, " " * 3000, "<|endoftext|>", *(t or "" for t in hard_texts())]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(ids, 7) == t and "".join(codec.decode_stream(np.frombuffer(ids, "<u4").tolist())) == t


def test_feeding_bytes_one_by_one(codec):
    data = ("internationalization" * 200).encode()
    machine = codec.transducer
    p, out = machine.start(), []
    for i in range(len(data)):
        out += machine.feed(p, data[i : i + 1])
        assert len(p.last) <= 8 * machine.longest + 2
    assert out + machine.end(p) == machine.encode(data)


def test_utf8_stream_holds_back_unfinished_characters():
    s = bpe.Utf8Stream()
    data = "aé中😀".encode()
    assert "".join(s.feed(data[i : i + 1]) for i in range(len(data))) + s.finish() == "aé中😀"
    assert s.feed(b"\xf0\x9f") == "" and s.finish() == "�"


def test_round_trips(spark):
    texts = hard_texts()
    rows = bpe.round_trips(table(spark, texts), RANKS, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
    out = bpe.encoded(table(spark, texts).withColumnRenamed("lang", "n_tokens"), RANKS, public_tokenizers.PATTERN)
    assert out.where("round_trip").count() == len(texts)
    assert bpe.round_trips(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark):
    texts = [*hard_texts(), "tab\tand\x1cseparator", "<|endoftext|> plain"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = list(range(len(texts)))[::-1]
    index = token_files.write_tokens(table(spark, texts, ids=ids), work_path(spark, "t"), path, seq_len=16)
    index.cache()
    rows = sorted(token_files.read_digests(index).collect())
    library = Tokenizer.from_file(path)
    assert library.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    start = 0
    for r, t in zip(rows, texts[::-1]):
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    files = {r["file"]: r["n"] for r in index.groupBy("file").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    for name, n in files.items():
        f = token_files.TokenFile(name)
        real = 0
        for i in range(-(-n // 16)):
            seq, mask = f.sequence(i)
            assert len(seq) == len(mask) == 16
            real += sum(mask.to_pylist())
        assert real == n
    index.unpersist()


def test_token_files_empty_null_and_repeated(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    empty = token_files.write_tokens(table(spark, []), work_path(spark, "t"), path)
    assert token_files.read_digests(empty).count() == 0
    docs = table(spark, ["b", "a", "a", None], ids=[4, 4, 4, None])
    got = token_files.read_digests(token_files.write_tokens(docs, work_path(spark, "t"), path)).collect()
    assert sorted(r["start"] for r in got) == [0, 1, 3, 5] and sum(r["doc_id"] is None for r in got) == 1


def test_token_files_with_clashing_names(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, ["one two", None, "three"]).selectExpr("*", "1 AS _h", "2 AS file", "3 AS first", "4 AS part", "5 AS start")
    got = token_files.read_digests(token_files.write_tokens(docs, work_path(spark, "t"), path)).collect()
    plain = token_files.read_digests(token_files.write_tokens(table(spark, ["one two", None, "three"]), work_path(spark, "t"), path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) == 3


def test_special_tokens_as_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a <|endoftext|>b", "<|endoftext", "plain"]
    for as_text in (False, True):
        library.encode_special_tokens = as_text
        own = token_files.Encoder(path, as_text)
        for t in texts:
            assert np.frombuffer(own(t), own.dtype).tolist() == library.encode(t, add_special_tokens=False).ids
