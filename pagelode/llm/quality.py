"""Quality rules: document statistics, and the frequency of lines across the documents of a host.

1. One pass over the texts gives each document's statistics and, per distinct normalised line, a 64-bit
   key of (host, line) and the words that its occurrences hold.
2. Documents are counted per key (a document gives a key once; partial aggregation), and keys in more than
   `max_docs` documents are frequent.
3. A frequent line is boilerplate and is removed. With `copies_once`, it is if more than `max_docs` distinct texts hold it:
   documents with the same set of lines count once, and so do near copies among the documents that are mostly (more than
   `most_frequent` of their words) frequent lines. A group of copies then doesn't reject itself: it is left to
   the duplicate operators, as in the pipeline. The query op8_quality_rules counts every document.
4. A document that keeps less than `least_left` of its words is depleted and rejected.

Frequent keys are written before documents meet them, so that Spark sends them out if they are few, and splits the documents of a
line that a third of them hold (a skewed join of two plain tables) if they aren't.

Defined results: null text counts as empty (no words, base_failed); a null source is a host of its own;
rows that repeat a doc_id are documents of their own, each with its own verdict.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_dedup
from .common import SPACES, alone, met, texts_as_bytes, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_DOCS, MOST_FREQUENT, LEAST_LEFT = 10, 0.5, 0.5
COPY_WORDS, COPY_PERCENT = 5, 80  # near copies, as the pipeline's next stage links them
_NOT_WORD_CHARS = SPACES + bytes(range(0x80, 0xC0))  # white space, and the continuation bytes of UTF-8
_SYMBOLS = b"#*$%&|<>"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

STATS_SCHEMA = "row_key long, content long, content2 long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<int>"


def repeated_words(words: list[bytes]) -> int:
    """Words in a 3-word window that is found twice or more, first included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def line_key(host: bytes, line: bytes) -> int:
    """Signed 64-bit key of a line of a host: lower case, words joined by one space."""
    return xxhash.xxh3_64_intdigest(host + b"\0" + b" ".join(line.translate(_LOWER).split())) - (1 << 63)


def text_stats(text: bytes, host: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    words = text.split()
    dup, seen, keys = 0, set(), {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            key = line_key(host, line)
            keys[key] = keys.get(key, 0) + n
    return (
        len(words),
        len(text.translate(None, _NOT_WORD_CHARS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        dup,
        repeated_words(words),
        list(keys),
        list(keys.values()),
    )


def _stats(batches):
    for batch in batches:
        hosts = ["\1" if x is None else "\2" + x for x in batch["source"].to_pylist()]
        rows = [text_stats(t, h.encode()) for t, h in zip(texts_as_bytes(batch["text"]), hosts)]
        cols = list(zip(*rows)) or [[]] * 7
        types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [batch["row_key"], batch["content"], batch["content2"], batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types))],
            names=["row_key", "content", "content2", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_keys", "line_words"],
        )


def content_keys(a: str, b: str) -> list:
    """Two hashes, 128 bits together, of what the verdict on a row depends on; equal rows have equal verdicts."""
    parts = [F.col("doc_id"), F.col("source").cast("string"), F.col("text")]
    return [F.xxhash64(*parts).alias(a), F.xxhash64(F.lit(b), *reversed(parts)).alias(b)]


def line_statistics(docs: DataFrame) -> DataFrame:
    """One row a document (STATS_SCHEMA), computed once and kept in the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), *content_keys("content", "content2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), "text")
    return written(rows.mapInArrow(alone(_stats), STATS_SCHEMA), "quality-stats")


def _copies(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(class, group): of documents that are mostly frequent lines, the classes that are near copies of another class."""
    classes = written(held.where("not other").groupBy("class").agg(F.min(F.struct("content", "content2")).alias("x")).select("class", "x.*"), "quality-classes")
    numbered = classes.select("content", "content2", F.col("class").alias("_class"))
    texts = docs.select(*content_keys("content", "content2"), "text").join(numbered, ["content", "content2"])
    texts = written(texts.groupBy(F.col("_class").alias("doc_id")).agg(F.first("text").alias("text")), "quality-texts")
    links = near_dedup.linked(texts, words=COPY_WORDS, percent=COPY_PERCENT).select(F.col("doc_id").alias("class"), F.col("component_id").alias("group"))
    several = links.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return links.join(several, "group").select("class", "group")


def boilerplate(docs: DataFrame, stats: DataFrame, max_docs: int = MAX_DOCS, most_frequent: float = MOST_FREQUENT, copies_once: bool = True) -> DataFrame:
    """(row_key, hit_keys, hit_words): per document the keys and words of its boilerplate lines; rows without are absent."""
    lines = stats.select(
        "row_key", "content", "content2", "n_words", F.xxhash64(F.array_sort("line_keys")).alias("class"), F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")
    ).select("row_key", "content", "content2", "n_words", "class", F.col("l.line_keys").alias("key"), F.col("l.line_words").alias("words"))
    frequent = (
        stats.select(F.explode("line_keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    )
    frequent = written(frequent, "frequent-lines")  # with their counts, by which the hot ones are split
    found = met(lines, frequent.select("key"), "key", frequent, "n", "row_key")
    if copies_once:
        held = (
            found.groupBy("row_key", "content", "content2", "n_words", "class")
            .agg(F.collect_list(F.struct("key", "words")).alias("hits"), F.sum("words").alias("w"))
            .withColumn("other", F.col("w") <= F.col("n_words") * F.lit(most_frequent))
        )
        held = written(held, "quality-held")
        if held.where("not other").take(1):
            groups = written(_copies(docs, held), "quality-copies")
            sizes = written(held.groupBy("class").agg(F.count("*").alias("n")), "quality-class-sizes")
            held = met(held, groups, "class", sizes, "n", "row_key", "left").withColumn("class", F.coalesce("group", "class"))
        own = held.select("row_key", "class", F.explode("hits").alias("h")).select("row_key", "class", "h.key", "h.words")
        boiler = own.groupBy("key").agg(F.countDistinct("class").alias("n")).where(F.col("n") > max_docs).select("key")
        found = met(own, written(boiler, "boilerplate"), "key", frequent, "n", "row_key")
    return found.groupBy("row_key").agg(F.collect_list("key").alias("hit_keys"), F.sum("words").alias("hit_words"))


def judged(
    docs: DataFrame, max_docs: int = MAX_DOCS, most_frequent: float = MOST_FREQUENT, least_left: float = LEAST_LEFT, copies_once: bool = True
) -> DataFrame:
    """One row a document: statistics, base_failed, hit_keys, n_left (words left), kept."""
    stats = line_statistics(docs)
    hits = boilerplate(docs, stats, max_docs, most_frequent, copies_once)
    return (
        stats.drop("line_keys", "line_words")
        .join(hits, "row_key", "left")
        .withColumn("n_left", F.col("n_words") - F.coalesce("hit_words", F.lit(0)))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= F.col("n_words") * F.lit(least_left)))
    )


def _without(batches):
    for batch in batches:
        names = [n for n in batch.schema.names if n != "hit_keys"]
        texts = batch["text"].to_pylist()
        for i, (host, hits) in enumerate(zip(batch["source"].to_pylist(), batch["hit_keys"].to_pylist())):
            if hits:
                gone, tag = set(hits), ("\1" if host is None else "\2" + str(host)).encode()
                lines = texts[i].encode().split(b"\n")
                texts[i] = b"\n".join(x for x in lines if not x.split() or line_key(tag, x) not in gone).decode()
        yield pa.RecordBatch.from_arrays([pa.array(texts, batch["text"].type) if n == "text" else batch[n] for n in names], names=names)


def filtered(docs: DataFrame, max_docs: int = MAX_DOCS, copies_once: bool = True) -> DataFrame:
    """The documents kept, without their boilerplate lines; columns as given (texts only change, n_chars with them)."""
    keys = ["_content", "_content2"]
    verdict = judged(docs, max_docs, copies_once=copies_once).where("kept").select(F.col("content").alias(keys[0]), F.col("content2").alias(keys[1]), "hit_keys").dropDuplicates(keys)
    clash = {c: f"_own_{c}" for c in docs.columns if c in (*keys, "hit_keys")}
    rows = docs.withColumnsRenamed(clash)
    kept = rows.select("*", *(x.alias(k) for x, k in zip(content_keys("content", "content2"), keys))).join(verdict, keys).drop(*keys)
    out = kept.mapInArrow(alone(_without), rows.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.withColumnsRenamed({b: a for a, b in clash.items()}).select(*docs.columns)


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judged(docs, copies_once=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")
