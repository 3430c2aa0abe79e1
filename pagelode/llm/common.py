"""Helpers shared by the training-data operators: shared folder, Arrow text buffers, block reading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into numpy arrays at a time; a longer text makes a block alone.
BLOCK_BYTES = 1 << 20
#: Bytes that separate words: space and \t \n \v \f \r, the ones bytes.split() splits at.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir, or in local mode a temporary one."""
    global _local_dir
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:  # a path without a scheme is one of Spark's default file system, whatever Python would take it for
        path = spark._jvm.org.apache.hadoop.fs.Path(set_dir)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="pagelode-")
        atexit.register(shutil.rmtree, _local_dir[len("file://") :], ignore_errors=True)
    return _local_dir


#: Paths handed out and not deleted since.
_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read again (lineage ends there)."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


#: A key of more than one part in so many of all rows is hot; there are fewer hot keys than this, whatever the table's size.
HOT_KEYS = 1000
#: Rows of a key that are never split.
HOT_ROWS = 100


def met(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, n: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with table on key (how: inner or left), no key's rows in one task: hot keys are dealt to parts by a hash of the column by.

    counts: (key, n), once for each key that may be hot, with its number of rows or an upper bound; cheap to read. Of the hot keys,
    fewer than HOT_KEYS, the names go out by broadcast, and their rows of table once to each part. Rows without a key, which a left
    join keeps, are dealt to HOT_KEYS parts. Columns: key, those of rows, those of table. An empty counts makes it a plain join.
    """
    part = max(HOT_ROWS, -(-(counts.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS))
    hot = F.broadcast(counts.where(F.col(n) > part).select(key, F.ceil(F.col(n) / part).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.when(F.col(key).isNull(), F.lit(HOT_KEYS)).otherwise(F.lit(1)))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return dealt.join(table.join(hot, key, "left").withColumn("_salt", copies).drop("_parts"), [key, "_salt"], how).drop("_salt")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def forget(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables that `written` has made, or work paths, which nothing reads any more."""
    for table in tables:
        place = table if isinstance(table, str) else table.work_path
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if place in _made:
            _made.remove(place)


def mark() -> int:
    """How many work paths there are: what comes later can be cleared by itself."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Deletes what was written in between, once the results are; from the since-th path on, but for those to keep. Returns how many paths are left."""
    forget(spark, *(p for p in _made[since:] if p not in keep))
    return len(_made)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or local path; works on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


_held: dict = {}


def held(key, make):
    """What a worker keeps from task to task, one thing at a time: asking for another one drops it."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what the worker keeps, and hands free memory back to the system."""
    import gc

    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Hands free memory back to the system: idle workers would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def alone(run):
    """A function for mapInArrow that first frees what other operators have left in the worker, and leaves nothing itself."""

    def wrapped(batches):
        release()
        yield from run(batches)
        trim()

    return wrapped


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"", pa.large_binary()))
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of documents with about `most` bytes together, each of one document at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def texts_as_bytes(column) -> Iterator[bytes]:
    """Each text of an Arrow string column as UTF-8; null as empty."""
    raw, offs = text_buffers(column)
    view = memoryview(raw)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield bytes(view[a:b])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64), in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = _powers(BASE, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(BASE, size), _powers(_INVERSE, size)
        return cls.up[:n], cls.down[:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial hash of raw[i:j], times base**i; modulo 2**64."""
    up, _ = _Powers.get(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of raw[start:end], independent of the place."""
    _, down = _Powers.get(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts])


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of the words [^\\x20\\x09-\\x0D]+ of all texts; none crosses texts."""
    if not len(raw):
        none = np.empty(0, np.int64)
        return none, none, none
    word = ~_IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True  # a text begins here
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
