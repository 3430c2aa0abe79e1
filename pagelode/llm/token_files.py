"""Token ids as Arrow IPC files of equal-length sequences.

A file holds record batches of `BATCH` rows with two fixed-size lists of `seq_len` items: `ids` (uint16 where
the vocabulary fits, else uint32) and `mask` (true for a real token). Documents follow each other in ascending
doc_id order, each closed by the end id; only the last sequence of a file is padded. Every batch but the last
has the same number of rows, so sequence i, or token i, is found by division, and reading it from a
memory-mapped file copies nothing. A document index (doc_id, file, first, n_tokens) goes beside the files.

The table is range-partitioned by doc_id (and a hash of the text, so that a repeated id doesn't make one
partition), and each attempt of a task writes a file of its own name. The index is a table that Spark commits: it names the
files of the attempts that counted, whole files each, and nothing reads another.

Reading back deals the index over tasks in runs of `READ_TOKENS` tokens of a file, so that it is as wide as the files are long.

Defined results: null text counts as empty (the end id alone); a null id sorts first; rows that repeat an id
follow each other, ordered by the hash of the text; an empty table gives no file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, held, work_path, written
from .pieces import PATTERN, Memo, plain, splitter

SEQ_LEN, BATCH, END_ID, READ_TOKENS = 2048, 32, 0, 1 << 20
#: Bytes of text whose tokens make a file.
FILE_BYTES = 256 << 20
INDEX_SCHEMA = "part int, file string, doc_id long, first long, n_tokens long"


class Encoder:
    """The tokenizers library; under byte-level splitting each piece is encoded once and remembered.

    The strings of added tokens in a text are those tokens, as the library has it; special_as_text makes them ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if special_as_text:
            self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", []) if not (special_as_text and t["special"])]
        self.added = re.compile("|".join(added)).search if added else lambda text: None
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces = splitter(PATTERN)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.memo = Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        """A piece as the library's byte-level splitting would hand it to the library's model."""
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.letters[32])
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.by_piece and plain(text) and not self.added(text):  # other texts may split otherwise: they go to the library whole
            return b"".join(map(self.memo.__getitem__, self.pieces(text)))
        return self._whole(text)


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable Latin-1 as is, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    return held(("encoder", path, special_as_text), lambda: Encoder(path, special_as_text))


class TokenFileWriter:
    """Appends documents to one file."""

    def __init__(self, stream, dtype, seq_len: int = SEQ_LEN):
        self.dtype, self.seq_len, self.n, self.kept = np.dtype(dtype), seq_len, 0, []
        self.held = 0
        self.item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(self.item, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_file(stream, self.schema)

    def append(self, ids: bytes) -> int:
        """Returns the place of the document's first token."""
        first = self.n
        self.kept.append(ids)
        size = len(ids) // self.dtype.itemsize
        self.n += size
        self.held += size
        if self.held >= BATCH * self.seq_len:
            self._flush(False)
        return first

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.kept), self.dtype)
        per = BATCH * self.seq_len
        whole = len(ids) // per * per
        for i in range(0, whole, per):
            self._batch(ids[i : i + per], per)
        rest = ids[whole:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.seq_len) * self.seq_len, self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
            rest = rest[:0]
        self.kept, self.held = [rest.tobytes()], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.item), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)],
                schema=self.schema,
            )
        )

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class TokenFile:
    """Random access to a file's sequences and tokens; memory-mapped where the file is local."""

    def __init__(self, uri: str):
        filesys, path = filesystem(uri)
        source = pa.memory_map(path) if filesys.type_name == "local" else filesys.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.per = BATCH * self.seq_len
        self._at, self._batch = -1, None

    def _get(self, i: int):
        if i != self._at:
            self._at, self._batch = i, self.reader.get_batch(i)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence i; the ids are a view of the file."""
        batch, k = self._get(i // BATCH), i % BATCH
        return batch["ids"].values.to_numpy()[k * self.seq_len : (k + 1) * self.seq_len], batch["mask"][k].values

    def tokens(self, first: int, n: int) -> np.ndarray:
        """Tokens first..first+n; a view where they lie in one batch."""
        parts = []
        while n > 0:
            at = first % self.per
            take = min(n, self.per - at)
            parts.append(self._get(first // self.per)["ids"].values.to_numpy()[at : at + take])
            first, n = first + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def _writer(folder: str, tokenizer: str, seq_len: int, end_id: int, special_as_text: bool):
    """Writes a partition's file under a name of the attempt's own; the index, which Spark commits, tells which files count."""

    def write(batches):
        enc = encoder(tokenizer, special_as_text)
        end = np.array([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        final = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        filesys, path = filesystem(final)
        stream = out = None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                filesys.create_dir(path.rpartition("/")[0], recursive=True)
                stream = filesys.open_output_stream(path)
                out = TokenFileWriter(stream, enc.dtype, seq_len)
            firsts, sizes = [], []
            for text in batch["text"]:
                ids = enc(text.as_py() or "") + end
                firsts.append(out.append(ids))
                sizes.append(len(ids) // enc.dtype.itemsize)
            n = len(firsts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([final] * n, pa.string()), batch["doc_id"], pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64())],
                names=["part", "file", "doc_id", "first", "n_tokens"],
            )
        if out is not None:
            out.close()
            stream.close()

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """Writes the files and returns the document index, with start, the tokens of all documents before."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_h", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    placed = rows.repartitionByRange(files, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    index = written(placed.mapInArrow(_writer(folder, tokenizer, seq_len, end_id, special_as_text), INDEX_SCHEMA), "token-index")
    # one row per file
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return index.join(files, "part").withColumn("start", F.col("base") + F.col("first")).drop("base")


def _reader(batches):
    at, file = None, None
    for batch in batches:
        crcs, counts = [], []
        for name, first, n in zip(batch["file"].to_pylist(), batch["first"].to_pylist(), batch["n_tokens"].to_pylist()):
            if name != at:
                at, file = name, TokenFile(name)
            ids = file.tokens(first, n)
            counts.append(len(ids))
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["start"], pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def read_digests(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files."""
    total = index.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // READ_TOKENS))
    rows = index.select("doc_id", "start", "file", "first", "n_tokens").repartition(tasks, "file", F.floor(F.col("first") / READ_TOKENS))
    return rows.sortWithinPartitions("file", "first").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_digests(write_tokens(docs, work_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")))
