"""WARC archives with an externally merged capture index.

Writing: pages are dealt to archives of some `ARCHIVE_BYTES` of payload; an archive holds gzip members, one per record, in order of
URL key, timestamp and page id, and one sorted run of the capture index (an Arrow IPC file of small batches). The record with the
smallest page id of equal payloads (of `MIN_REVISIT` bytes or more) is a response, the others are revisits that refer
to it; which one that is comes from a partial aggregation of digests, before any payload is moved.

Merging: runs undergo k-way merges by a loser tree. While there are more than `FAN_IN` runs, groups of FAN_IN runs are
merged into longer ones; the last merge is cut into key ranges, one task each, that seek to their place in every run.
A task holds one batch per run. Range borders come from a bounded number of keys per run.

Files have names of the attempt that writes them, and count by the tables of runs that Spark commits: a task that is run again, or
twice, leaves files that nothing names.

Defined results: null html is an empty payload; a null URL has the key "-"; rows that repeat the smallest page id
with an equal payload are all responses; a null page id stands first in its order, refers to nobody and is referred to
by nobody; columns other than page_id, url, html and ts are left out; an empty table gives no archive and an empty history.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, filesystem, met, work_path, written

MIN_REVISIT, FAN_IN, RUN_ROWS, KEYS_PER_RUN = 100, 64, 512, 16
#: Bytes of payload in an archive; records that a task reads back, and bytes of an archive that go to one task.
ARCHIVE_BYTES, READ_RECORDS = 256 << 20, 4096
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Order of the capture index: URL key, timestamp, page id.
CAPTURE = pa.schema(
    [("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
CAPTURE_SCHEMA = "url_key string, ts string, page_id long, file string, offset long, length long"
RUN_SCHEMA = "run string, n long, keys array<struct<url_key:string,ts:string,page_id:long>>"


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query: captures of a site, then of a page, stand together."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url
    key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


@F.pandas_udf(T.StringType())
def _url_keys(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: url_key(u if isinstance(u, str) else None))


def record(url: str, page_id, payload: bytes, digest: str, ts: str, refers_to=None) -> bytes:
    """One gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=''':/?#[]@!$&'()*+,;=%~''')}",
        f"WARC-Date: {ts}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        body = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        body = http + b"\r\n"
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}", "Content-Type: application/http; msgtype=response"]
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class LoserTree:
    """Merges sorted iterators; a leaf's key is replayed only along its path to the root."""

    def __init__(self, iterators, key):
        self.its, self.key, self.k = [iter(x) for x in iterators], key, max(1, len(iterators))
        self.rows, self.keys = [None] * self.k, [None] * self.k
        self.losers = [-1] * self.k
        for i in range(len(self.its)):
            self._pull(i)
        self.winner = self._build(1) if self.k > 1 else 0

    def _pull(self, i: int) -> None:
        row = next(self.its[i], None)
        self.rows[i], self.keys[i] = row, None if row is None else self.key(row)

    def _less(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        while self.keys[self.winner] is not None:
            yield self.rows[self.winner]
            at = self.winner
            self._pull(at)
            node = (at + self.k) // 2
            while node >= 1:
                if self._less(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def capture_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


class _Output:
    """A file of an attempt's own name; it counts once the table that names it is committed, when it is whole."""

    def __init__(self, uri: str):
        self.filesys, self.path = filesystem(uri)
        self.filesys.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.filesys.open_output_stream(self.path, compression=None)

    def done(self) -> None:
        self.stream.close()


def _write_run(uri: str, rows) -> tuple[str, int, list]:
    """Writes sorted rows as one run, holding one batch at a time; returns it with some of its keys."""
    out, n, keys, every, held = _Output(uri), 0, [], 1, []
    with pa.ipc.new_file(out.stream, CAPTURE) as file:

        def flush():
            if held:
                file.write_batch(pa.RecordBatch.from_pydict({f.name: [r[i] for r in held] for i, f in enumerate(CAPTURE)}, CAPTURE))
                held.clear()

        for row in rows:
            if n % every == 0:
                keys.append(row[:3])
                if len(keys) >= 2 * KEYS_PER_RUN:
                    keys, every = keys[::2], every * 2
            held.append(row)
            n += 1
            if len(held) >= RUN_ROWS:
                flush()
        flush()
    out.done()
    return uri, n, keys


def _run_batch(runs: list[tuple[str, int, list]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64())]))
    keys = [[dict(zip(("url_key", "ts", "page_id"), k)) for k in r[2]] for r in runs]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in runs], pa.string()), pa.array([r[1] for r in runs], pa.int64()), pa.array(keys, kind)], names=["run", "n", "keys"]
    )


def read_run(uri: str, low: tuple | None = None, high: tuple | None = None):
    """Rows of a run from low (inclusive) to high (exclusive); seeks by the first key of each batch."""
    filesys, path = filesystem(uri)
    source = pa.memory_map(path) if filesys.type_name == "local" else filesys.open_input_file(path)
    reader = pa.ipc.open_file(source)

    def rows(i):
        return list(zip(*(c.to_pylist() for c in reader.get_batch(i).columns)))

    a, b = 0, reader.num_record_batches
    if low is not None:
        while b - a > 1:
            mid = (a + b) // 2
            batch = reader.get_batch(mid).slice(0, 1)
            if capture_key(tuple(c[0].as_py() for c in batch.columns)) < low:
                a = mid
            else:
                b = mid
    for i in range(a, reader.num_record_batches):
        for row in rows(i):
            key = capture_key(row)
            if high is not None and key >= high:
                return
            if low is None or key >= low:
                yield row


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and runs below folder; one row a run (RUN_SCHEMA)."""
    names = set(pages.columns)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"),
        "url",
        payload.alias("payload"),
        (F.coalesce(F.col("ts").cast("string"), F.lit(DATE)) if "ts" in names else F.lit(DATE)).alias("ts"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    long = F.octet_length("payload") >= MIN_REVISIT
    # digests are joined without the payloads, those of hot payloads in parts; payloads then meet their reference by page id
    digests = written(rows.where(long).select("page_id", "digest"), "warc-digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c")).where("c > 1")
    first = written(first, "warc-first")
    ids = met(digests, first.drop("c"), "digest", first.select("digest", "c"), "c", "page_id").where(F.col("page_id") != F.col("first_id"))
    ids = ids.select("page_id", F.col("digest").alias("_digest"), F.col("first_id").alias("refers_to")).dropDuplicates(["page_id", "_digest"])
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    archives = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ARCHIVE_BYTES))
    dealt = rows.repartition(archives, "page_id", "digest")
    full = dealt.join(ids.withColumnRenamed("page_id", "_page"), (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    full = full.select("page_id", "url", "payload", "ts", "digest", "refers_to", _url_keys("url").alias("url_key"))
    placed = full.sortWithinPartitions("url_key", "ts", "page_id")

    def write(batches):
        """Records in order; the run beside them has the same order and names the archive of the same attempt."""
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        name, out, at, captures = f"{folder}/archive-{part:06d}-{own}.warc.gz", None, 0, []
        for batch in batches:
            for page, url, text, ts, digest, ref, key in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = _Output(name)
                member = record(url, page, text.encode(), digest, ts, ref)
                out.stream.write(member)
                captures.append((key, ts, page, name, at, len(member)))
                at += len(member)
        if out is not None:
            out.done()
            yield _run_batch([_write_run(f"{folder}/run-0-{part:06d}-{own}.arrow", captures)])

    return written(placed.mapInArrow(alone(write), RUN_SCHEMA), "warc-runs")


def history(runs: DataFrame, folder: str, ranges: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """The capture index in global order of URL key, timestamp and page id: (range, ...CAPTURE); order holds within and across ranges."""
    spark = runs.sparkSession
    level = 0
    paths = sorted(r["run"] for r in runs.select("run").toLocalIterator())
    while len(paths) > fan_in:
        level += 1
        groups = [paths[i : i + fan_in] for i in range(0, len(paths), fan_in)]

        def merge(batches, level=level):
            for batch in batches:
                for no, group in zip(batch["no"].to_pylist(), batch["group"].to_pylist()):
                    tree = LoserTree([read_run(p) for p in group], capture_key)
                    yield _run_batch([_write_run(f"{folder}/run-{level}-{no:06d}-{uuid.uuid4().hex}.arrow", tree)])

        table = spark.createDataFrame(list(enumerate(groups)), "no long, group array<string>").repartition(len(groups))
        runs = written(table.mapInArrow(alone(merge), RUN_SCHEMA), "warc-runs")
        paths = sorted(r["run"] for r in runs.select("run").toLocalIterator())
    if not paths:
        return spark.createDataFrame([], "range int, " + CAPTURE_SCHEMA)
    keys = sorted(capture_key((k["url_key"], k["ts"], k["page_id"])) for r in runs.select("keys").toLocalIterator() for k in r["keys"])
    n = ranges or max(1, min(len(keys), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    borders = sorted({keys[len(keys) * i // n] for i in range(1, n)})
    cuts = list(zip([None, *borders], [*borders, None]))

    def merged(batches):
        for batch in batches:
            for no in batch["range"].to_pylist():
                low, high = cuts[no]
                held = []
                for row in LoserTree([read_run(p, low, high) for p in paths], capture_key):
                    held.append((no, *row))
                    if len(held) >= 4096:
                        yield _captures(held)
                        held = []
                if held:
                    yield _captures(held)

    table = spark.range(0, len(cuts), 1, len(cuts)).select(F.col("id").cast("int").alias("range"))  # a task a range
    return table.mapInArrow(alone(merged), "range int, " + CAPTURE_SCHEMA)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("range", pa.int32()), *CAPTURE])
    return pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)


RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Archives that a task of readers keeps open.
OPEN = 64


def read_records(captures: DataFrame, tasks: int | None = None) -> DataFrame:
    """The records that the captures point at, in the order of the history: a range of it is one task's, from its first capture to its last.
    Digests of responses are computed anew and compared with the header."""
    tasks = tasks or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        handles: dict = {}
        for batch in batches:
            rows = []
            for name, offset, length in zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist()):
                if (handle := handles.pop(name, None)) is None:
                    if len(handles) >= OPEN:
                        handles.pop(next(iter(handles))).close()
                    filesys, path = filesystem(name)
                    handle = filesys.open_input_file(path)
                handles[name] = handle  # the last one used stands last
                handle.seek(offset)
                headers, payload = parse(handle.read(length))
                page = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                page = None if page == "None" else int(page)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                kind, ref = headers["WARC-Type"], headers.get("WARC-Refers-To")
                if kind == "response":
                    size = len(payload)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name} at {offset}: the payload differs from its digest")
                else:
                    size = int(headers["X-Payload-Length"])
                rows.append((page, size, digest, kind, int(ref[len("<urn:page:") : -1]) if ref else None))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )

    order = ["range", "url_key", F.col("ts"), F.col("page_id").asc_nulls_first(), "file", "offset"]
    in_order = captures.repartition(tasks, "range").sortWithinPartitions(*order).select("file", "offset", "length")
    return in_order.mapInArrow(alone(run), RECORD_SCHEMA)


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = work_path(spark, "warc")
    runs = archived(pages, folder)
    records = runs.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records // READ_RECORDS))
    return read_records(written(history(runs, folder, ranges), "warc-history"), ranges)
