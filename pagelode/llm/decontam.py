"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Items are lower-cased (A-Z) and cut into words; the automaton over word ids recognises every run of words of
any item. A document's words stream through it; the length of the longest match that ends at each word is
tracked, and words inside a match of `n` words or more (or of a whole item, if that is shorter) are hit.

The items go to the workers in blocks of at most `BLOCK_WORDS` words, one automaton each; an item longer than a
block is cut into pieces that overlap by n - 1 words, so no window is lost. The texts pass up to `CHAINED` blocks in one
narrow stage, where nothing but the items is moved. Of a larger benchmark that many blocks are sent out at a time, the rows
with hits are written, and the hits of all blocks meet the documents at the end.

Defined results: null or wordless items have no window; null text has no words; repeated items each count; null
item ids are left out of the lists; extra columns pass through; empty tables give no hits.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, texts_as_bytes, unused, written

N, BLOCK_WORDS, CHAINED, MAX_COVERAGE = 10, 50_000, 4, 0.5
#: Letters, digits and all bytes beyond ASCII are kept, A-Z lower-cased; all else separates words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Of several word sequences; `owners` are their ids."""

    def __init__(self, items: list[tuple[str, list[bytes], bool]], n: int = N):
        """items: (id, words, whole); whole: a sequence of fewer than n words is a window itself."""
        self.n, self.vocab = n, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shorts: dict[int, list[tuple[int, str]]] = {}
        self.owners: list[set | None] = [None]
        least = n
        for owner, words, whole in items:
            if not words:
                continue
            at = 0
            for w in words:
                at = self._add(at, self.vocab.setdefault(w, len(self.vocab)))
            if whole and len(words) < n:
                self.shorts.setdefault(at, []).append((len(words), owner))
                least = min(least, len(words))
        self.least = least
        for owner, words, _ in items:
            at = 0
            for w in words:
                at = self.next[at][self.vocab[w]]
                if self.length[at] >= n:
                    self._own(at, owner)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            up = self.link[v]
            if self.owners[v] and self.length[up] >= n:
                for owner in self.owners[v]:
                    self._own(up, owner)
        order = sorted(range(1, len(self.next)), key=lambda v: self.length[v])
        #: Per state, the state that holds the n-word end of its matches, and the short items that end them.
        self.at_n, self.ending = [0] * len(self.next), [()] * len(self.next)
        for v in order:
            up = self.link[v]
            if self.length[v] >= n:
                self.at_n[v] = self.at_n[up] if self.length[up] >= n else v
            self.ending[v] = (*self.shorts.get(v, ()), *self.ending[up])

    def _own(self, v: int, owner: str) -> None:
        if self.owners[v] is None:
            self.owners[v] = set()
        self.owners[v].add(owner)

    def _add(self, last: int, c: int) -> int:
        """Appends c to a sequence that ends in state last; returns the new end."""
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._new(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.owners.append(None)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal ranges [a, b) of words that are hit, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        get = self.vocab.get
        ids = [get(w, -1) for w in words]
        least, total, i = self.least, len(ids), 0
        while i < total:
            if ids[i] < 0:
                i += 1
                continue
            j = i + 1
            while j < total and ids[j] >= 0:
                j += 1
            if j - i >= least:
                self._run(ids, i, j, spans, found)
            i = j + 1
        return spans, found

    def _run(self, ids, i, j, spans, found) -> None:
        nxt, link, length, n = self.next, self.link, self.length, self.n
        v = l = 0
        for k in range(i, j):
            c = ids[k]
            while v and c not in nxt[v]:
                v = link[v]
                l = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                l += 1
            size = 0
            if l >= n:
                size = n
                found |= self.owners[self.at_n[v]] or set()
            for short, owner in self.ending[v]:
                if short <= l:
                    size = max(size, short)
                    found.add(owner)
            if size:
                a = k + 1 - size
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, k + 1))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, n: int = N, block_words: int = BLOCK_WORDS):
    """Yields lists of (id, words, whole) of at most block_words words; reads the items partition by partition."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        words = words_of((row["text"] or "").encode())
        step = max(1, block_words - n + 1)
        for a in range(0, max(1, len(words) - n + 1), step):
            piece = words[a : a + step + n - 1]
            if not piece:
                continue
            if size and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((row["i"], piece, len(words) < n))
            size += len(piece)
    if block:
        yield block


FOUND = "array<struct<a:int,b:int>>"


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.withColumn("hit_spans", F.array().cast(FOUND)).withColumn("hit_items", F.array().cast("array<string>"))


def _scans(docs: DataFrame, benchmark: DataFrame, n: int, block_words: int):
    """Per block of items, a function that adds its hits to batches of prepared docs, and the block's broadcast."""
    for block in item_blocks(benchmark, n, block_words):
        shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches, names, shared=shared, key=key):
            for batch in batches:
                machine = held(key, lambda: SuffixAutomaton(shared.value, n))
                spans, items = batch["hit_spans"].to_pylist(), batch["hit_items"].to_pylist()
                for i, text in enumerate(texts_as_bytes(batch["text"])):
                    ranges, found = machine.hits(words_of(text))
                    if ranges or found:
                        spans[i] = [*spans[i], *({"a": a, "b": b} for a, b in ranges)]
                        items[i] = sorted({*items[i], *(x for x in found if x is not None)})
                new = {"hit_spans": spans, "hit_items": items}
                columns = [pa.array(new[c], batch[c].type) if c in new else batch[c] for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        yield scan, shared


def _keyed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with two hashes, 128 bits together, of id and text; rows with equal ones have equal hits."""
    return rows.select("*", F.xxhash64("doc_id", "text").alias(keys[0]), F.xxhash64(F.lit("hits"), "text", "doc_id").alias(keys[1]))


def _before_last(docs: DataFrame, benchmark: DataFrame, n: int, block_words: int) -> tuple[DataFrame, list]:
    """docs with the hits of all blocks but the last CHAINED at most, and the scans of those. A task runs CHAINED scans at most, and as many
    blocks are sent out at a time: the hits of more blocks are written first, those rows alone that have any, and joined to docs."""
    chain, tables = [], []
    own = docs.select("doc_id", "text", "hit_spans", "hit_items")
    keys, spans, items = [unused(docs, "key"), unused(docs, "key2")], unused(docs, "spans"), unused(docs, "items")
    for scan in _scans(docs, benchmark, n, block_words):
        if len(chain) == CHAINED:
            out = own
            for run, _ in chain:
                out = out.mapInArrow(partial(run, names=own.columns), own.schema)
            hits = _keyed(out.where("size(hit_spans) > 0 OR size(hit_items) > 0"), keys).select(*keys, F.col("hit_spans").alias(spans), F.col("hit_items").alias(items))
            tables.append(written(hits.dropDuplicates(keys), "hits"))
            for _, shared in chain:
                shared.destroy()
            chain = []
        chain.append(scan)
    if tables:
        found = tables[0]
        for t in tables[1:]:
            found = found.unionByName(t)
        found = found.groupBy(*keys).agg(F.flatten(F.collect_list(spans)).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
        found = written(found, "hits")
        names = docs.columns
        joined = _keyed(docs, keys).join(found, keys, "left")
        new = {"hit_spans": F.coalesce(spans, "hit_spans"), "hit_items": F.coalesce(items, "hit_items")}
        docs = joined.select(*(new[c].alias(c) if c in new else c for c in names))
    return docs, [run for run, _ in chain]


def marked(docs: DataFrame, benchmark: DataFrame, n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with hit_spans (ranges of words hit, not merged across blocks) and hit_items."""
    return _marked_and(docs, benchmark, n, iter, None, block_words)


def _marked_and(docs: DataFrame, benchmark: DataFrame, n: int, finish, schema, block_words: int = BLOCK_WORDS) -> DataFrame:
    """finish over the batches of marked docs, in the same Python pass as the last block's scan."""
    out = _prepared(docs)
    out, chain = _before_last(out, benchmark, n, block_words)
    names = out.columns
    for scan in chain[:-1]:
        out = out.mapInArrow(partial(scan, names=names), out.schema)
    last = partial(chain[-1], names=names) if chain else iter
    return out.mapInArrow(lambda batches: finish(last(batches)), schema or out.schema)


def digests(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)"""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans, items in zip(texts_as_bytes(batch["text"]), batch["hit_spans"].to_pylist(), batch["hit_items"].to_pylist()):
                hit = sum(b - a for a, b in _merged([(x["a"], x["b"]) for x in spans]))
                rows.append((len(words_of(text)), hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return _marked_and(rows, benchmark, n, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without the hit spans; documents of which more than max_coverage of the words are hit go whole."""
    clash = [c for c in docs.columns if c in ("hit_spans", "hit_items")]
    safe = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    names, schema = safe.columns, safe.schema

    def cut(batches):
        for batch in batches:
            keep, texts = [], batch["text"].to_pylist()
            for i, spans in enumerate(batch["hit_spans"].to_pylist()):
                if not spans:
                    keep.append(True)
                    continue
                data = texts[i].encode()
                at = [m.span() for m in _WORD.finditer(data)]
                ranges = _merged([(x["a"], x["b"]) for x in spans])
                keep.append(sum(b - a for a, b in ranges) <= max_coverage * len(at))
                out, last = [], 0
                for a, b in ranges:
                    out.append(data[last : at[a][0]])
                    last = at[b - 1][1]
                texts[i] = b"".join([*out, data[last:]]).decode()
            columns = [pa.array(texts, batch[c].type) if c == "text" else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    out = _marked_and(safe, benchmark, n, cut, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(schema["n_chars"].dataType), F.col("n_chars")))
    return out.withColumnsRenamed({f"_own_{c}": c for c in clash}).select(*docs.columns)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
