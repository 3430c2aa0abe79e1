"""What the two exact repeat operators share: block files, rounds that name pieces of text globally, and answers to blocks.

Texts are cut into blocks of `BLOCK_TEXT` bytes and each block is written once to the shared folder, before anything is
numbered: whatever a task says about a block is about that file, also if the task is run again. A block's number and its file come
from the table that Spark commits, so a lost attempt's file is never looked at. From then on only packed arrays move:

* A round (`named`, `met`) sends the distinct names found in a block to buckets; a bucket tells each block which of its names
  are met in another place, and which are hot. The answer is two bits a name, joined back to the block: no filter is sent to all
  tasks, and nothing saturates. Names are hashes, sent as 5 bytes besides their bucket: two that collide count as met, which lets
  text through to the comparison without need and changes no result.
* What is still in question is sent to buckets to be compared, and the answers return to the block. A bucket gets what stands under one
  name; of a hot one (a passage that a third of all documents hold has other surroundings in each) the windows are named one by one
  instead, a round tells which of them are met, and only those are sent, each to a bucket of its own name.
* The block's file gives the rows of the result, so texts are never shuffled.

Buckets are drawn from the bytes of all texts (`BUCKET_TEXT` each), so that a task holds as much at any size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, blocks, filesystem, text_buffers, work_path, written

BLOCK_TEXT, BUCKET_TEXT = 4 << 20, 16 << 20
BLOB_SCHEMA = "target long, kind int, blob binary"
#: Numbers of blocks are above, those of buckets below.
FIRST_BLOCK = 1 << 62
#: Kinds of rows: pieces of text sent to a bucket, and names; a block's files, and what returns to a block: which windows of a piece are
#: found (of those sent late in a row of their own), and which names are met.
SENT, NAMES, FILES, ANSWER, LATE, MET = range(6)
#: A name under which more distinct pieces of text stand is hot: pieces aren't brought together by it.
HOT = 4096


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    target, kind, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(target, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["target", "kind", "blob"]
    )


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, compressed together."""
    data = b"".join(a.tobytes() for a in arrays)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def by_target(batches):
    """(target, [(kind, blob), ...]) of batches sorted by target."""
    at, held = None, []
    for batch in batches:
        for target, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if held and target != at:
                yield at, held
                held = []
            at = target
            held.append((kind, blob))
    if held:
        yield at, held


def gathered(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows of BLOB_SCHEMA, those of a target together. Buckets and blocks are dealt to the tasks in turn: a hash would give some several and others none."""
    return rows.repartitionById(tasks, F.pmod("target", F.lit(tasks)).cast("int")).sortWithinPartitions("target", "kind")


# -- block files -------------------------------------------------------------------------------------------------


def put(folder: str, data: bytes) -> str:
    """Writes a file of its own name and returns where it is."""
    uri = f"{folder}/{uuid.uuid4().hex}"
    filesys, path = filesystem(uri)
    filesys.create_dir(path.rpartition("/")[0], recursive=True)
    with filesys.open_output_stream(path) as out:
        out.write(data)
    return uri


def get(uri: str) -> bytes:
    filesys, path = filesystem(uri)
    with filesys.open_input_file(path) as source:
        return source.read()


def ipc_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def buckets_for(spark, total: int) -> int:
    """Buckets, and tasks, for texts of so many bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TEXT))


def stored(folder: str, most: int = BLOCK_TEXT):
    """Writes the block files of Arrow batches below a folder; rows (number, bytes of text, place of the file)."""

    def run(batches):
        number = FIRST_BLOCK + (TaskContext.get().partitionId() << 32 if TaskContext.get() else 0)
        for batch in batches:
            _, offs = text_buffers(batch["text"])
            rows = []
            for i, j in blocks(offs, most):
                number += 1
                rows.append((number, int(offs[j] - offs[i]), put(folder, ipc_bytes(batch.slice(i, j - i))).encode()))
            if rows:
                numbers, size, blob = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())], names=["target", "size", "blob"])

    return run


class Blocks:
    """The block files of a table: rows (number, FILES, place of the file), and how many buckets and tasks its size asks for."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.folder = work_path(spark, "text-blocks")
        found = written(docs.mapInArrow(alone(stored(self.folder)), "target long, size long, blob binary"), "blocks")
        total = found.agg(F.sum("size")).first()[0] or 0
        self.buckets = buckets_for(spark, total)
        self.rows = found.select("target", F.lit(FILES).alias("kind"), "blob")

    def gathered(self, rows: DataFrame) -> DataFrame:
        return gathered(rows, self.buckets)


def rows_of(blob: bytes) -> pa.RecordBatch:
    """The rows of a block; the blob names the block's file first."""
    with pa.ipc.open_stream(get(blob.partition(b"\n")[0].decode())) as reader:
        return reader.read_next_batch()


def own_files(held) -> bytes:
    """The row that names a block's files; without it an answer would be about a block that isn't there."""
    return next(x for kind, x in held if kind == FILES)


def sub_blocks(batch: pa.RecordBatch):
    """(first row, bytes, offsets) of parts of a block that are turned into arrays at a time."""
    raw, offs = text_buffers(batch["text"])
    for i, j in blocks(offs):
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


# -- rounds ------------------------------------------------------------------------------------------------------


def dealt(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of names by bucket, where each bucket ends)"""
    bucket = (names % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))


def _dealt(names: np.ndarray, buckets: int):
    """(distinct names in order of buckets, how often each is there, where each bucket ends, place of each given name)"""
    distinct, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    order, ends = dealt(distinct, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], counts[order], ends, place[inverse]


def named(block: int, names: np.ndarray, buckets: int, pieces: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """A block's names, packed for their buckets: each once, and for those that the block has twice or more the number of distinct
    pieces that stand under it (hashes of them, one a name given), 255 at most."""
    distinct, counts, ends, place = _dealt(names, buckets)
    kinds = np.minimum(counts, 1)
    some = np.flatnonzero(counts[place] > 1) if pieces is not None else []
    if len(some):
        at, pieces = place[some], pieces[some]
        by = np.lexsort((pieces, at))
        new = np.r_[True, (at[by][1:] != at[by][:-1]) | (pieces[by][1:] != pieces[by][:-1])]
        kinds = np.bincount(at[by][new], minlength=len(distinct))
    packed = (distinct // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    often, kinds = counts > 1, np.minimum(kinds, 255).astype("u1")
    head, out = np.int64(block).tobytes(), []
    for b, (s, e) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
        if e > s:
            out.append((b, NAMES, head + np.int64(e - s).tobytes() + packed[s:e].tobytes() + np.packbits(often[s:e]).tobytes() + kinds[s:e][often[s:e]].tobytes()))
    return out


def meet_names(target: int, blobs: list[bytes]) -> pa.RecordBatch:
    """A bucket: which names are met twice, and which are hot, as bits to each block."""
    heads = [np.frombuffer(x, "<i8", 2).tolist() for x in blobs]
    often = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, -(-n // 8), 16 + 5 * n), count=n) for x, (_, n) in zip(blobs, heads)]).astype(bool)
    values = np.zeros((len(often), 8), np.uint8)
    values[:, :5] = np.concatenate([np.frombuffer(x, np.uint8, 5 * n, 16) for x, (_, n) in zip(blobs, heads)]).reshape(-1, 5)
    values = values.view("<u8").ravel()
    weight = np.ones(len(often), np.int64)
    weight[often] = np.concatenate([np.frombuffer(x, "u1", offset=16 + 5 * n + -(-n // 8)) for x, (_, n) in zip(blobs, heads)])
    order = np.argsort(values)
    first = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
    size = np.diff(np.r_[first, len(order)])
    hot = np.empty(len(order), bool)
    hot[order] = np.repeat(np.add.reduceat(weight[order], first) > HOT, size)
    often[order] |= np.repeat(size > 1, size)
    ends = np.cumsum([n for _, n in heads])
    head = np.int64(target).tobytes()
    return blob_batch([(block, MET, head + np.packbits(often[e - n : e]).tobytes() + np.packbits(hot[e - n : e]).tobytes()) for (block, n), e in zip(heads, ends.tolist())])


def buckets_of(pieces=None):
    """What buckets do with names, and by pieces(list of blobs) with pieces of text. What is addressed to a block passes on."""

    def run(batches):
        for target, held in by_target(batches):
            if target >= FIRST_BLOCK:
                yield blob_batch([(target, kind, x) for kind, x in held])
                continue
            names = [x for kind, x in held if kind == NAMES]
            if names:
                yield meet_names(target, names)
            sent = [x for kind, x in held if kind == SENT]
            if sent:
                yield from pieces(sent)

    return run


meet = buckets_of()


def met(names: np.ndarray, answers: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For the names that a block has sent, whether each is met twice or more, and whether it is hot."""
    distinct, _, ends, place = _dealt(names, buckets)
    often, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    starts = np.r_[0, ends[:-1]]
    for x in answers:
        b = int(np.frombuffer(x, "<i8", 1)[0])
        n = int(ends[b] - starts[b])
        bits = np.frombuffer(x, np.uint8, offset=8).reshape(2, -1)
        often[starts[b] : ends[b]], hot[starts[b] : ends[b]] = np.unpackbits(bits, axis=1, count=n)
    return often[place], hot[place]


def answers_of(held, wanted: int = ANSWER) -> list[bytes]:
    return [x for kind, x in held if kind == wanted]


# -- answers -----------------------------------------------------------------------------------------------------

#: Of the piece `at` of a block, the windows t to t + n.
RUN = np.dtype([("at", "<u4"), ("t", "u1"), ("n", "u1")])


def runs(at: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Windows (piece, number), ascending, as runs."""
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (t[1:] != t[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    out = np.zeros(len(first), RUN)
    out["at"], out["t"] = at[first], t[first]
    out["n"] = np.diff(np.r_[first, len(at)])
    return out


def marked(answers: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window of each piece, which windows the answers name)"""
    first = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    for x in answers:
        r = np.frombuffer(x, RUN)
        count = r["n"].astype(np.int64)
        out[np.repeat(first[r["at"]] + r["t"], count) + steps(count)] = True
    return first, out


def steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def merged_ranges(starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal ranges covered by [s, s + length) of ascending starts, as rows (from, to)."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    new = np.r_[True, starts[1:] > starts[:-1] + length]
    return np.stack([starts[new], starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]] + length], axis=1)


def ranges_by_row(row: np.ndarray, start: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Row of the block -> ranges covered by windows of a length."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    return {int(row[s]): merged_ranges(np.unique(start[s:e]), length) for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(row)])}
