"""Near-duplicate documents by SetSketch registers.

1. Each text becomes its set of 4-word shingles (64-bit hashes) and a sketch: register i holds the minimum of the i-th
   hash over the set, truncated to an exponentially spaced grid. Sketches of two sets merge by the larger register
   and agree in a register with a probability close to the sets' similarity.
2. Texts with equal sets form a class; it has a number of its own, and the document with the smallest id gives its text.
3. Registers are cut into bands; documents that share a band are candidates. Within a bucket all are first compared with
   the smallest document. A pair's similarity is estimated from its registers by maximum likelihood; pairs that can't
   reach the threshold (by five standard deviations) go, the rest are confirmed on the full sets.
4. Buckets that still hold several components are compared further, in blocks of bounded size. First each document
   outside the bucket's first component proposes its likeliest partner in another component, which merges most
   groups. Then each such document is compared with all others of other components, by their whole sets (32-bit
   hashes; what comes within half a percent of the threshold or above it is confirmed on the full sets), where the block
   joins components as it goes; a pair is looked at in the first bucket it shares. Nothing but links leaves a
   block: no link between documents that share a band is lost, no bucket has a cap, and no list of pairs is made.
   A pair at the threshold shares no band with a probability of (1 - 0.8**4)**25 = 2e-6.
5. Components of the links come from alternating large-star and small-star rounds, each written to the shared
   folder; at `SMALL_EDGES` links or fewer, counted, one task ends the work. Hot documents and buckets are salted: a
   document's set is sent once to every `SALT_ROWS` of its partners.

Defined results: null or wordless text has an empty set and is linked with nothing; rows that repeat a doc_id
are one vertex, linked if any of their texts is, in `linked`; a null id has a null component and is kept. `deduplicated` keeps texts
rather than ids: unlike texts of one id both stay, of rows equal in id and text one does, and rows with an empty set
or a null id all do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, LOWER, alone, blocks, forget, met, mixed, prefix_hashes, span_hashes, text_buffers, unused, word_spans, written

WORDS, PERCENT = 4, 80
BANDS, ROWS = 25, 4
REGISTERS = BANDS * ROWS
GRID = 1.02  # spacing of the register values
_SHIFT = 256
SALT_ROWS, BLOCK_ROWS, BROADCAST_IDS, SMALL_EDGES = 256, 1024, 1_000_000, 1 << 20

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_PLACES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """Yields each text's sorted distinct shingle hashes; a text of fewer words, but not none, is one shingle."""
    low = LOWER[raw]
    starts, ends, doc = word_spans(low, offsets)
    h = span_hashes(prefix_hashes(low), starts, ends)
    n = len(h)
    windows = np.zeros(max(0, n - words + 1), np.uint64)
    for i in range(words):
        windows += h[i : n - words + 1 + i] * _PLACES[i]
    windows = mixed(windows)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            yield np.unique(windows[a : b - words + 1])
        elif b > a:
            short = (h[a:b] * _PLACES[words : words + b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
            yield mixed(short * BASE)
        else:
            yield np.empty(0, np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set; for an empty one all 0."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = (x[i : i + 2048, None] ^ _MASKS) * _FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    e = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(e) / np.log(GRID)) + _SHIFT, 1, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


_STEPS = np.linspace(0.02, 1.0, 50)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (GRID - 1) / GRID) / np.log(GRID)


def likely_similarity(more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, from how many registers of a are above and below those of b and the sizes."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)  # no similarity can be above
    j = top[:, None] * _STEPS
    above = _p(u[:, None] - v[:, None] * j)
    below = _p(v[:, None] - u[:, None] * j)
    even = np.clip(1 - above - below, 1e-12, 1)
    ll = more[:, None] * np.log(np.maximum(above, 1e-12)) + less[:, None] * np.log(np.maximum(below, 1e-12))
    ll += (REGISTERS - more - less)[:, None] * np.log(even)
    return j[np.arange(len(j)), ll.argmax(axis=1)]


def _cut(percent: int) -> float:
    t = percent / 100
    return t - 5 * (t * (1 - t) / REGISTERS) ** 0.5


def _likely(one: np.ndarray, size: int, many: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarities of a set with many, from their sketches; 0 where the pair can't be linked."""
    out = np.zeros(len(sizes))
    at = np.flatnonzero(100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))
    if len(at):  # the likelihood only for what agrees in enough registers (a linked pair agrees in 80 on average)
        at = at[(many[at] == one).sum(1) >= (_cut(percent) - 0.05) * REGISTERS]
    if len(at):
        other = many[at]
        got = likely_similarity((one > other).sum(1), (one < other).sum(1), np.full(len(at), size, float), sizes[at].astype(float))
        out[at] = np.where(got < _cut(percent), 0, got)
    return out


SKETCH_SCHEMA = "doc_id long, text_key long, n_shingles long, set_key binary, regs binary"


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row a document, computed once and kept in the shared folder."""

    def run(batches):
        for batch in batches:
            raw, offs = text_buffers(batch["text"])
            sizes, keys, regs = [], [], []
            for i, j in blocks(offs):
                for s in shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words):
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "set_key", "regs"],
            )

    return written(_rows(docs).mapInArrow(alone(run), SKETCH_SCHEMA), "sketches")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): id and key name a text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, text) of the classes wanted (v, doc_id, text_key); these go out by broadcast if they are counted to be few enough."""
    few = wanted.count() <= BROADCAST_IDS
    found = _rows(docs).join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_key"])
    return found.groupBy("v").agg(F.first("text").alias("text"))  # rows may repeat


def _confirm(words: int, percent: int):
    """Streams rows sorted by (center, salt, member or center itself first); yields confirmed links."""

    def sets(text: str):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return next(shingle_sets(raw, np.array([0, len(raw)]), words))

    def run(batches):
        at, centers = None, []
        for batch in batches:
            a, b = [], []
            for center, salt, own, node, text, regs in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (center, salt):
                    at, centers = (center, salt), []
                if own == 0:
                    if text is not None:
                        centers.append((sets(text), np.frombuffer(regs, np.uint16)))
                    continue
                mine, sketched = None, np.frombuffer(regs, np.uint16)
                for s, r in centers:
                    if mine is None:
                        mine = sets(text)
                    if not _likely(r, len(s), sketched[None], np.array([len(mine)]), percent)[0]:
                        continue
                    both = len(np.intersect1d(s, mine, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(mine) - both):
                        a.append(center)
                        b.append(node)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those linked on their full sets. nodes: (v, text, regs). Each center's set goes once to every SALT_ROWS partners."""
    hot = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).where("salts > 1"), "hot-centers")
    salted = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    members = salted.join(nodes.withColumnRenamed("v", "b"), "b").select(
        F.col("a").alias("center"), "salt", F.lit(1).alias("own"), F.col("b").alias("node"), "text", "regs"
    )
    centers = (
        salted.select("a", "salt").distinct().join(nodes.withColumnRenamed("v", "a"), "a")
        .select(F.col("a").alias("center"), "salt", F.lit(0).alias("own"), F.col("a").alias("node"), "text", "regs")
    )
    rows = members.unionByName(centers).repartition("center", "salt").sortWithinPartitions("center", "salt", "own")
    return rows.mapInArrow(alone(_confirm(words, percent)), "a long, b long")


def _joined(batches):
    """All links of a graph: each vertex with the smallest that can be reached."""
    none = np.empty(0, np.int64)
    held = [(r["v"].to_numpy(), r["m"].to_numpy()) for r in batches]
    a, b = np.concatenate([none, *(x for x, _ in held)]), np.concatenate([none, *(x for _, x in held)])
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["v", "component"])


def components(links: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex that can be reached, for vertices with links. Alternates large-star and small-star until
    nothing changes; where the links are counted to be few, one task joins them at once."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    if edges.count() <= SMALL_EDGES:
        out = written(edges.repartition(1).mapInArrow(alone(_joined), "v long, component long"), "components")
        forget(edges.sparkSession, edges)
        return out
    before = None
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), "m").where("v != m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v")
        small = small.select("v", F.col("least").alias("m")).unionByName(small.where("m != least").select(F.col("m").alias("v"), F.col("least").alias("m")))
        edges, old = written(small.where("v != m").distinct(), "edges"), edges
        forget(edges.sparkSession, old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select("v", F.col("m").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("v"), "component").distinct())


def _by_block(batches, emit):
    """Calls emit with the rows of each (bucket, block) of batches sorted by them."""
    key, held = None, []
    for batch in batches:
        for bucket, block, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (bucket, block):
                if held:
                    yield emit(held)
                key, held = (bucket, block), []
            held.append(row)
    if held:
        yield emit(held)


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _columns(rows):
    ids, comps, sizes = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
    return ids, comps, sizes, np.stack([np.frombuffer(r[3], np.uint16) for r in rows]), np.array([r[5] for r in rows], bool)


def _proposals(percent: int):
    """Of each document outside the bucket's first component, the likeliest partner in another component."""

    def emit(rows):
        ids, comps, sizes, regs, home = _columns(rows)
        a, b = [], []
        for i in (i for i, r in enumerate(rows) if r[4]):
            at = np.flatnonzero((comps != comps[i]) & home)
            got = _likely(regs[i], sizes[i], regs[at], sizes[at], percent)
            if got.any():
                best = at[np.lexsort((ids[at], -got))[0]]
                a.append(min(ids[best], ids[i]))
                b.append(max(ids[best], ids[i]))
        return _pairs(a, b)

    return lambda batches: _by_block(batches, emit)


_NEAR_PERCENT = 0.5


def _links_within(percent: int):
    """Links between components of a block, by whole sets; components are joined as links are found."""

    def emit(rows):
        ids, comps, sizes, regs, home = _columns(rows)
        root = np.unique(comps, return_inverse=True)[1]
        bands = regs.reshape(len(rows), BANDS, ROWS)
        band, sets = rows[0][6], [np.frombuffer(r[7], np.uint32) for r in rows]
        a, b = [], []
        for i in (i for i, r in enumerate(rows) if r[4]):
            at = np.flatnonzero((root != root[i]) & home)
            if not len(at):
                continue
            got = _likely(regs[i], sizes[i], regs[at], sizes[at], percent)
            some = got > 0
            at, got = at[some], got[some]
            first = (bands[at] == bands[i]).all(axis=2).argmax(axis=1) == band
            at, got = at[first], got[first]
            for j in at[np.lexsort((ids[at], -got))].tolist():
                if root[j] == root[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                likeness = 100 * both / max(1, len(sets[i]) + len(sets[j]) - both)
                if likeness >= percent - _NEAR_PERCENT:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    if likeness >= percent + _NEAR_PERCENT:  # sure to be confirmed
                        root[root == root[j]] = root[i]
        return _pairs(a, b)

    return lambda batches: _by_block(batches, emit)


def _short_sets(nodes: DataFrame, words: int) -> DataFrame:
    """(v, short): sets of 32-bit hashes, sorted."""

    def run(batches):
        for batch in batches:
            raw, offs = text_buffers(batch["text"])
            out = []
            for i, j in blocks(offs):
                for s in shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words):
                    out.append(np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([batch["v"], pa.array(out, pa.binary())], names=["v", "short"])

    return nodes.select("v", "text").mapInArrow(alone(run), "v long, short binary")


def classes_of(own: DataFrame) -> DataFrame:
    """Classes of equal sets: their number v, how many rows they have, and the smallest (doc_id, text_key) with its sketch."""
    sets = own.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    least = sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "regs")).alias("x"), F.count("*").alias("rows"))
    return written(least.select("set_key", "x.*", "rows", F.monotonically_increasing_id().alias("v")), "classes")


def linked_classes(docs: DataFrame, classes: DataFrame, also: DataFrame | None, words: int, percent: int) -> DataFrame:
    """(v, component) of the classes with links; also: links (a, b) that hold anyway."""
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {2 * ROWS} + 1, {2 * ROWS})))")
    banded = classes.select("v", F.posexplode(band).alias("band", "bucket"))
    shared = written(banded.groupBy("bucket").agg(F.min("v").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    members = written(met(banded, shared, "bucket", shared.select("bucket", "n"), "n", "v").select("bucket", "band", "v", "first", "n"), "buckets")
    stars = written(members.where("v != first").select(F.col("first").alias("a"), F.col("v").alias("b")).distinct(), "stars")
    regs = classes.select("v", "n_shingles", "regs")
    wanted = classes.select("v", "doc_id", "text_key").join(members.select("v").distinct(), "v", "left_semi")
    nodes = written(_texts_of(docs, wanted).join(regs, "v").select("v", "text", "regs"), "nodes")
    links = confirmed(stars, nodes, words, percent)
    found = components(links if also is None else links.unionByName(also))

    def cut(rows):
        return F.ceil(F.col(rows) / BLOCK_ROWS).cast("int")

    def dealt(parts):
        return F.pmod(F.xxhash64("v"), parts).cast("int")

    def several(found):
        """Members of the buckets that hold several components, in groups of bounded size: a bucket's members are dealt to blocks, those
        outside its first component (minor ones) to chunks as well, and a group is a block with a chunk, all pairs of which meet."""
        placed = members.join(found, "v", "left").withColumn("component", F.coalesce("component", "v"))
        split = placed.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(
            F.min("component").alias("main"), F.count("*").alias("components"), (F.sum("c") - F.min_by("c", "component")).alias("minors")
        )
        rows = met(placed, split.where("components > 1"), "bucket", shared.select("bucket", "n"), "n", "v").withColumn("minor", F.col("component") != F.col("main"))
        rows = rows.withColumn("home", dealt(cut("n"))).withColumn("own", dealt(cut("minors")))
        at_home = F.transform(F.sequence(F.lit(0), cut("minors") - 1), lambda c: F.struct(F.col("home").alias("block"), c.alias("chunk")))
        as_minor = F.transform(F.sequence(F.lit(0), cut("n") - 1), lambda b: F.struct(b.alias("block"), F.col("own").alias("chunk")))
        places = F.when(F.col("minor"), F.array_union(at_home, as_minor)).otherwise(at_home)
        rows = rows.withColumn("place", F.explode(places)).join(regs, "v")
        block, chunk = F.col("place.block"), F.col("place.chunk")
        return rows.select(
            "bucket", F.concat_ws("-", block, chunk).alias("block"), "v", "component", "n_shingles", "regs",
            (F.col("minor") & (chunk == F.col("own"))).alias("minor"), (block == F.col("home")).alias("is_home"), "band",
        )

    def by_block(rows, run):
        return rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(alone(run), "a long, b long").distinct()

    def joined(found, links):
        return components(found.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(links)) if links.take(1) else found

    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    likeliest = written(by_block(several(found), _proposals(percent)).join(tested, ["a", "b"], "left_anti"), "pairs")
    found = joined(found, written(confirmed(likeliest, nodes, words, percent), "links"))
    rest = written(several(found), "rest")
    short = _short_sets(nodes.join(rest.select("v").distinct(), "v", "left_semi"), words)
    near = written(by_block(rest.join(short, "v").select(*rest.columns, "short"), _links_within(percent)), "pairs")
    found = joined(found, written(confirmed(near, nodes, words, percent), "links"))
    forget(docs.sparkSession, shared, members, stars, nodes, likeliest, rest, near)
    return found


def _repeated_ids(own: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(doc_id, v, w, least): of ids with several sets, or with rows without a set beside one with, the classes, and the first
    of them with its smallest id. None if there are no such ids."""
    key = F.xxhash64("set_key")
    sets = F.when(F.col("set_key").isNotNull(), key)
    ids = own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi"), F.count("set_key").alias("n"), F.count("*").alias("rows"))
    ids = written(ids.where("lo != hi OR n > 0 AND n < rows").select("doc_id"), "repeated-ids")
    if not ids.take(1):
        return None
    keyed = own.where("set_key IS NOT NULL").join(ids, "doc_id").select("doc_id", "set_key").distinct()
    keyed = keyed.join(classes.select("set_key", "v", F.col("doc_id").alias("least")), "set_key").select("doc_id", "v", "least")
    first = keyed.groupBy("doc_id").agg(F.min(F.struct(F.col("v").alias("w"), "least")).alias("x")).select("doc_id", "x.*")
    return written(keyed.select("doc_id", "v").join(first, "doc_id"), "id-classes")


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    own = sketches(docs, words)
    classes = classes_of(own)
    ids = _repeated_ids(own, classes)
    also = None if ids is None else ids.where("v != w").select(F.col("w").alias("a"), F.col("v").alias("b")).distinct()
    found = linked_classes(docs, classes, also, words, percent)
    copied = written(classes.where("rows > 1").select("set_key", "rows"), "copied-sets")
    in_groups = classes.select("v", "set_key", "doc_id").join(found, "v")
    least = in_groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = in_groups.join(least, "component").select("set_key", "v", "component_id")
    alone_ = classes.where("rows > 1").join(found, "v", "left_anti").select("set_key", "v", F.col("doc_id").alias("component_id"))
    rows = own.select("doc_id", "n_shingles", "set_key", F.monotonically_increasing_id().alias("row"))  # own is a written table: its rows keep their places
    out = met(rows, by_class.unionByName(alone_).drop("v"), "set_key", copied, "rows", "row", "left").drop("row")
    component = F.coalesce("component_id", "doc_id")
    if ids is not None:  # rows without a set belong to the other texts of their id
        home = ids.select("doc_id", "w", "least").distinct().join(by_class.select(F.col("v").alias("w"), F.col("component_id").alias("of")), "w", "left")
        home = home.select("doc_id", F.coalesce("of", "least").alias("home"))
        out = out.where("set_key IS NOT NULL").withColumn("home", F.lit(None).cast("long")).unionByName(out.where("set_key IS NULL").join(home, "doc_id", "left"))
        component = F.coalesce("component_id", "home", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of equal ids that with the smallest key of its text. Columns as given."""
    own = sketches(docs, words)
    classes = classes_of(own)
    found = linked_classes(docs, classes, None, words, percent)
    groups = classes.join(found, "v").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.*")
    single = classes.join(found, "v", "left_anti").select("doc_id", "text_key")
    free = own.where("set_key IS NULL OR doc_id IS NULL").select("doc_id", "text_key").distinct()
    id_, key, one = (unused(docs, name) for name in ("kept_id", "kept_key", "kept_one"))
    verdict = groups.unionByName(single).withColumn(one, F.lit(True)).unionByName(free.withColumn(one, F.lit(False)))
    verdict = verdict.withColumnsRenamed({"doc_id": id_, "text_key": key})
    rows = docs.join(verdict, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)))
    kept = rows.where(one).dropDuplicates([id_, key])
    return kept.unionByName(rows.where(~F.col(one))).select(*docs.columns)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
