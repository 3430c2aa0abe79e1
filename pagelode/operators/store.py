"""The chunk table: rows dealt to buckets by a hash of their URL and, within, to folders by the day of their capture; replaced page by page, never in place.

A version is a manifest that names a folder for each bucket of `chunks` and of `pages` (one row a page: hash and times). Replacing pages
writes new folders for the buckets that they are in and a manifest with the others' folders as they were; readers take the
newest manifest. A manifest appears whole, by a rename. Two writers at once aren't arbitrated.

The day is a partition column: a search for fresh pages, or a list of stale ones, reads the folders of the days that it asks for. A vector index
of one version serves later ones too: buckets whose folders have changed since are scanned, the others are searched by its cells.
"""

from __future__ import annotations

import atexit
import contextlib
import datetime
import hashlib
import json
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector_index import VectorIndex

CHUNKS = (
    "point_id string, url string, title string, heading string, chunk_index int, chunk_text string, summary string, "
    "content_selector string, capture_date timestamp, content_hash string, embedding array<float>"
)
#: Columns that folders are named by.
PLACES = {"chunks": "write string, bucket int, day date", "pages": "write string, bucket int"}
PAGES = "url string, content_hash string, capture_date timestamp, last_checked timestamp, n_chunks int"
BUCKETS = 64

_local: str | None = None


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share; in local mode without it, below a temporary folder."""
    global _local
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if _local is None:
            _local = "file://" + tempfile.mkdtemp(prefix="pagelode-")
            atexit.register(shutil.rmtree, _local[len("file://") :], ignore_errors=True)
        base = _local
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables in between that nothing has deleted yet.
_tables: list[str] = []


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new work folder, which `passing` deletes."""
    _tables.append(work_folder(spark, name))
    return _tables[-1]


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage: a table of its own, which `passing` deletes."""
    path = passing_folder(df.sparkSession, "level")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """The tables that `materialised` makes within are deleted at the end: what is read from them must be written by then."""
    since = len(_tables)
    try:
        yield
    finally:
        for path in _tables[since:]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        del _tables[since:]


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, dimensions: int, buckets: int = BUCKETS):
        """buckets counts when the table is made; a table keeps its number."""
        self.spark, self.path, self.dimensions, self.buckets = spark, path.rstrip("/"), dimensions, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names(self.path) if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def exists(self) -> bool:
        return bool(self.versions())

    def _manifest(self, version: int) -> dict:
        fs, p = self._fs(f"{self.path}/v{version:08d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _latest(self) -> dict:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._manifest(found[-1])

    def _publish(self, manifest: dict, version: int) -> None:
        final = f"{self.path}/v{version:08d}.json"
        fs, temp = self._fs(f"{self.path}/_{uuid.uuid4().hex}")
        stream = fs.create(temp, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not fs.rename(temp, self._fs(final)[1]):
            raise FileExistsError(f"{final} is there already: another writer has made it")

    def _written(self, rows: DataFrame, kind: str, buckets: int, order: list[str]) -> dict[str, str]:
        """Folders of the buckets that have rows; large buckets have many files, sorted so that statistics prune by url."""
        folder = f"data/{kind}/write={uuid.uuid4().hex}"
        dealt, by = rows.withColumn("bucket", bucket_of(F.col("url"), buckets)), ["bucket"]
        if kind == "chunks":
            dealt, by = dealt.withColumn("day", F.to_date("capture_date")), ["bucket", "day"]
        dealt = dealt.repartitionByRange(*by, "url").sortWithinPartitions(*by, *order)
        dealt.write.partitionBy(*by).parquet(f"{self.path}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(f"{self.path}/{folder}") if n.startswith("bucket=")}

    def ensure(self) -> None:
        """Makes an empty table; an existing one must have the same vector size."""
        if not self.exists():
            for kind, schema in (("chunks", CHUNKS), ("pages", PAGES)):
                self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/data/no-{kind}")
            self._publish({"buckets": self.buckets, "chunks": {}, "pages": {}}, 1)
            return
        row = self.chunks().select(F.size("embedding").alias("n")).where("n >= 0").take(1)
        if row and row[0]["n"] != self.dimensions:
            raise ValueError(f"the table holds vectors of {row[0]['n']} dimensions, the provider gives {self.dimensions}")

    def _read(self, kind: str, manifest: dict, only: set[str] | None = None) -> DataFrame:
        schema = f"{CHUNKS if kind == 'chunks' else PAGES}, {PLACES[kind]}"
        folders = [f"{self.path}/{f}" for b, f in sorted(manifest[kind].items()) if only is None or b in only]
        if not folders:
            return self.spark.read.schema(schema).parquet(f"{self.path}/data/no-{kind}")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{kind}").parquet(*folders)

    def chunks(self, url: str | None = None, since=None, before=None) -> DataFrame:
        """All chunks, or those of the bucket that a URL is in; since and before bound their capture, and the days that are read."""
        manifest = self._latest()
        only = None if url is None else {str(int(hashlib.md5(url.encode()).hexdigest()[:8], 16) % manifest["buckets"])}
        return self._captured(self._read("chunks", manifest, only), since, before).drop("write", "bucket", "day")

    @staticmethod
    def _captured(rows: DataFrame, since, before) -> DataFrame:
        """A day more at either end: days are those of the time zone that the rows were written in."""
        at = lambda x: F.lit(x).cast("timestamp")
        if since is not None:
            rows = rows.where((F.col("day").isNull() | (F.col("day") >= F.date_sub(F.to_date(at(since)), 1))) & (F.col("capture_date") >= at(since)))
        if before is not None:
            rows = rows.where((F.col("day").isNull() | (F.col("day") <= F.date_add(F.to_date(at(before)), 1))) & (F.col("capture_date") < at(before)))
        return rows

    # -- the vector index -----------------------------------------------------------------------------------------

    def build_index(self, **how) -> int:
        """Makes a vector index of the newest version, beside the table, and returns the version."""
        version = self.versions()[-1]
        manifest = self._manifest(version)
        rows = self._read("chunks", manifest).drop("write")
        carried = tuple(c for c in rows.columns if c not in ("point_id", "embedding"))
        VectorIndex.build(rows, f"{self.path}/index/v{version:08d}", "point_id", "embedding", carried, **how)
        return version

    def indexes(self) -> list[int]:
        """Versions that have an index; one appears with its list of cells, which is written last."""
        found = sorted(int(n[1:]) for n in self._names(f"{self.path}/index") if n[1:].isdigit())
        return [v for v in found if "_SUCCESS" in self._names(f"{self.path}/index/v{v:08d}/cells")]

    def near(self, query, probes: int | None = 0, since=None, before=None) -> DataFrame:
        """The chunks that a query is compared with: of unchanged buckets those in the index's cells near it, of buckets that have changed since the index
        was made (or without an index) all. For `search` and `top_k`."""
        manifest, have = self._latest(), [v for v in self.indexes() if v in self.versions()]
        columns = [x.split(" ")[0] for x in CHUNKS.split(", ")]
        old = self._manifest(have[-1])["chunks"] if have else {}
        same = {b for b, f in manifest["chunks"].items() if old.get(b) == f}
        rest = set(manifest["chunks"]) - same
        out = self._captured(self._read("chunks", manifest, rest), since, before).select(*columns) if rest or not same else None
        if same:
            cells = VectorIndex(self.spark, f"{self.path}/index/v{have[-1]:08d}").near(query, probes)
            cells = self._captured(cells.withColumnsRenamed({"id": "point_id", "v": "embedding"}), since, before)
            cells = cells.where(F.col("bucket").isin(sorted(map(int, same)))).select(*columns)
            out = cells if out is None else out.unionByName(cells)
        return out

    def pages(self) -> DataFrame:
        return self._read("pages", self._latest()).drop("write", "bucket")

    def count(self) -> int:
        return self.chunks().count()

    def replace_pages(self, new: DataFrame, checked: DataFrame | None = None, as_of=None, changed: DataFrame | None = None) -> None:
        """All rows of the pages in `new` take the place of what their URLs had. changed: (url, content_hash) of all pages that changed; those
        without rows in `new` have no chunk any more. checked: URLs seen unchanged, whose last_checked moves. Only buckets of
        these pages are written: those of chunks for changed pages, those of pages for all."""
        with passing(self.spark):
            self._replace(new, checked, as_of, changed)

    def _replace(self, new: DataFrame, checked: DataFrame | None, as_of, changed: DataFrame | None) -> None:
        manifest, version = self._latest(), self.versions()[-1] + 1
        n = manifest["buckets"]
        columns = [x.split(" ")[0] for x in CHUNKS.split(", ")]
        new = new.select(*columns)
        counts = new.groupBy("url").agg(F.max("content_hash").alias("_hash"), F.max("capture_date").alias("_at"), F.count("*").cast("int").alias("n"))
        if changed is None:
            changed = counts.select("url", F.col("_hash").alias("content_hash"))
        at = F.coalesce("_at", F.lit(as_of).cast("timestamp"))
        state = materialised(
            changed.select("url", "content_hash").dropDuplicates(["url"]).join(counts, "url", "left").select(
                "url", "content_hash", at.alias("capture_date"), at.alias("last_checked"), F.coalesce("n", F.lit(0)).alias("n_chunks")
            )
        )
        seen = None if checked is None else materialised(checked.select("url").distinct().withColumn("_seen", F.lit(as_of).cast("timestamp")))

        def touched(rows: DataFrame) -> set[str]:
            return {str(r["b"]) for r in rows.select(bucket_of(F.col("url"), n).alias("b")).distinct().collect()}  # at most a row a bucket

        chunk_buckets = touched(state)
        page_buckets = chunk_buckets | (touched(seen) if seen is not None else set())
        if not page_buckets:
            return
        kept = lambda kind, buckets: {b: f for b, f in manifest[kind].items() if b not in buckets}
        out = {"buckets": n, "chunks": manifest["chunks"], "pages": kept("pages", page_buckets)}
        if chunk_buckets:
            old = self._read("chunks", manifest, chunk_buckets).join(state.select("url"), "url", "left_anti").select(*columns)
            out["chunks"] = kept("chunks", chunk_buckets) | self._written(old.unionByName(new), "chunks", n, ["url", "chunk_index"])
        old = self._read("pages", manifest, page_buckets).join(state.select("url"), "url", "left_anti")
        if seen is not None:
            old = old.join(seen, "url", "left").withColumn("last_checked", F.coalesce("_seen", "last_checked")).drop("_seen")
        out["pages"] |= self._written(old.select(*state.columns).unionByName(state), "pages", n, ["url"])
        self._publish(out, version)

    def vacuum(self, keep: int = 2) -> None:
        """Drops all but the newest versions, and the folders that no version left names."""
        found = self.versions()
        indexed = [v for v in self.indexes() if v in found][-1:]  # the newest index needs the manifest of its version
        found = [v for v in found if v not in indexed or v in found[-keep:]]
        used = {f for v in {*found[-keep:], *indexed} for kind in ("chunks", "pages") for f in self._manifest(v)[kind].values()}
        for version in self.indexes():
            if version not in indexed:
                fs, p = self._fs(f"{self.path}/index/v{version:08d}")
                fs.delete(p, True)
        for version in found[:-keep]:
            fs, p = self._fs(f"{self.path}/v{version:08d}.json")
            fs.delete(p, False)
        for kind in ("chunks", "pages"):
            for write in self._names(f"{self.path}/data/{kind}"):
                for name in self._names(f"{self.path}/data/{kind}/{write}"):
                    if name.startswith("bucket=") and f"data/{kind}/{write}/{name}" not in used:
                        fs, p = self._fs(f"{self.path}/data/{kind}/{write}/{name}")
                        fs.delete(p, True)


def classified(new: DataFrame, state: DataFrame) -> DataFrame:
    """new (url, content_hash) with `change`: new, changed or unchanged against the page state."""
    old = state.select("url", F.col("content_hash").alias("_old"), F.lit(True).alias("_known"))
    change = F.when(F.col("_known").isNull(), "new").when(F.col("_old").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("changed")
    return new.join(old, "url", "left").withColumn("change", change).drop("_old", "_known")


def replaced(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing without the keys of new, and new."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
