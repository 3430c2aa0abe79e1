"""Approximate nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component that makes them units, so that the largest inner product is the smallest
distance. In each of TABLES tables a vector falls into the bucket of m values floor((a.x + b) / w), a normal (2-stable), b uniform. For a
query, a neighbour of cosine c has the projections c * a.q + noise of deviation sqrt(1 - c^2): that gives each perturbed bucket its chance to
hold the neighbour, and buckets are visited from the likeliest on until their chances sum to `mass`. What the visited buckets of
all tables hold is scored by its exact inner product in double precision.

Bounds. A sample of SAMPLE queries (a parameter) is compared with all rows, in one pass: it gives c (the lower decile of the similarity of
the k-th neighbour) and `mass` (as much as RECALL of the sample's neighbours need). m grows with the number of rows, until a query would
visit more than PROBES buckets. If even that can't reach the sample's neighbours, m is 0: all is one bucket, and the search is exact.
Every row is indexed. Of equal vectors only the k + 1 with the smallest ids can be among any k nearest, so others leave before they
are moved. Buckets form groups by their first values, groups are cut into parts of CHUNK_BYTES by a hash of the id, and a task holds one part at a
time, while the queries that visit it stream by. Rows that a query gets follow the parts it visits.

Vectors that are null, zero, hold null or non-finite components, or have no id take no part, nor do those whose length isn't the most frequent one
(of equally frequent ones the largest). If an id stands in several rows: as a query its smallest vector counts, as a
candidate its nearest one; a query never finds its own id. Equal scores go by the smaller id. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alone, written

TABLES, K, EVERY = 2, 20, 20
#: Width of a value in deviations of a projection.
WIDTH = 2.0
#: Share of the sample's neighbours that must be found, and how many queries the sample has.
RECALL, SAMPLE = 0.98, 128
BUCKET_ROWS, PROBES, CHUNK_BYTES = 64, 512, 8 << 20
#: Bits that a value tells, of unit projections and of ones with deviation s (log2(s) more).
_BITS = 0.5 * math.log2(2 * math.pi * math.e) - math.log2(WIDTH)
_erf = np.vectorize(math.erf, otypes=[float])


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, but for their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow column of equally long lists, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on: equal rows have equal products, wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Hashes:
    """The functions of all tables, and what a query visits."""

    def __init__(self, size: int, scale: float, tables: int, functions: int, first: int, cosine: float, mass: float, seed: int = 12):
        """first: so many functions name a group of buckets."""
        rng = np.random.default_rng(seed)
        self.scale, self.tables, self.m, self.first, self.cosine, self.mass = scale, tables, functions, first, cosine, mass
        self.a = rng.standard_normal((tables, functions, size + 1))
        self.b = rng.uniform(0, WIDTH, (tables, functions))
        self.names = rng.integers(1, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, group) of vectors; equal values of all functions make a bucket."""
        unit = x / self.scale
        rest = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))
        values = np.floor((unit @ self.a[table, :, :-1].T + rest[:, None] * self.a[table, :, -1] + self.b[table]) / WIDTH).astype(np.int64)
        parts = np.cumsum(values.astype(np.uint64) * self.names, axis=1, dtype=np.uint64)
        zero = np.zeros(len(x), np.uint64)
        return parts[:, -1] if self.m else zero, parts[:, self.first - 1] if self.first else zero

    def visits(self, q: np.ndarray, table: int, mass: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, their groups, chances summed so far) of one query, from the likeliest bucket on, until the chances reach the mass."""
        along = self.a[table, :, :-1] @ (q / np.linalg.norm(q))
        mean, s = self.cosine * along + self.b[table], math.sqrt(1 - self.cosine**2)
        key = group = np.zeros(1, np.uint64)
        chance = np.ones(1)
        for j in range(self.m):
            values = np.arange(math.floor((mean[j] - 4 * s) / WIDTH), math.floor((mean[j] + 4 * s) / WIDTH) + 1)
            edges = _erf((np.append(values, values[-1] + 1) * WIDTH - mean[j]) / (s * math.sqrt(2))) / 2
            key = (key[:, None] + values.astype(np.int64).astype(np.uint64) * self.names[j]).ravel()
            chance = (chance[:, None] * np.diff(edges)).ravel()
            group = key if j < self.first else np.repeat(group, len(values))
            order = np.argsort(-chance, kind="stable")
            sums = np.cumsum(chance[order])  # what can't belong to the likeliest buckets goes early; all of it is a small part of the rest
            kept = order[: np.searchsorted(sums, sums[-1] - (1 - mass) / (3 * self.m)) + 1]
            key, chance, group = key[kept], chance[kept], group[kept]
        sums = np.cumsum(chance)
        n = min(int(np.searchsorted(sums, mass)) + 1, len(key)) if self.m else 1
        return key[:n], group[:n], sums[:n]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _indexed(hashes: Hashes, batches):
    for batch in batches:
        if len(batch):
            x = matrix(batch["v"])
            for t in range(hashes.tables):
                key, group = hashes.keys(x, t)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32)), _signed(key))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), _signed(group), batch["id"], batch["v"], keys], names=["t", "g", "id", "v", "keys"])


def _visited(hashes: Hashes, batches):
    """A row for each group that a query visits, with the buckets there."""
    for batch in batches:
        tables, groups, rows, lists = [], [], [], []
        for i, q in enumerate(matrix(batch["v"]) if len(batch) else ()):
            for t in range(hashes.tables):
                key, group, _ = hashes.visits(q, t, hashes.mass)
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order])) + 1
                for own in np.split(order, cuts):
                    tables.append(t)
                    groups.append(group[own[0]])
                    rows.append(i)
                    lists.append(key[own])
        if rows:
            taken = batch.take(pa.array(rows, pa.int32()))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([pa.array(tables, pa.int32()), _signed(np.array(groups, np.uint64)), taken["id"], taken["v"], keys], names=["t", "g", "id", "v", "keys"])


class _Part:
    """The vectors of one part, by bucket."""

    def __init__(self):
        self.pieces, self.ready = [], False

    def add(self, ids, x, keys):
        self.pieces.append((ids, x, keys))

    def close(self):
        if not self.ready:
            ids, x, keys = (np.concatenate(c) for c in zip(*self.pieces))
            order = np.lexsort((ids, keys))
            self.ids, self.x = ids[order], x[order]
            self.keys, starts = np.unique(keys[order], return_index=True)
            self.ends = np.append(starts, len(keys))
            self.ready, self.pieces = True, []

    def nearest(self, ids, q, keys, offsets, k: int, most: int = 400_000):
        """(query row, id, score) of the k best that each query finds in the buckets it visits. Products of matrices choose some more than
        k, as they round; exact ones decide."""
        self.close()
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        row, bucket = np.repeat(np.arange(len(q)), np.diff(offsets))[hit], at[hit]
        order = np.argsort(bucket, kind="stable")
        row, bucket = row[order], bucket[order]
        slack = 1e-12 * np.linalg.norm(q, axis=1) * (np.abs(self.x).max() * math.sqrt(q.shape[1]))
        low, some, n = np.full(len(q), -np.inf), [], 0

        def best(some, k, low=None):
            r, v, s = (np.concatenate(c) for c in zip(*some))
            order = np.lexsort((self.ids[v], -s, r))
            r, v, s = r[order], v[order], s[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            if low is not None:
                last = rank == k - 1
                low[r[last]] = s[last] - slack[r[last]]
            return [(r[rank < k], v[rank < k], s[rank < k])]

        for own in np.split(np.arange(len(row)), np.flatnonzero(np.diff(bucket)) + 1):
            if not len(own):
                continue
            a, e = self.ends[bucket[own[0]]], self.ends[bucket[own[0]] + 1]
            who = row[own]
            scores = q[who] @ self.x[a:e].T
            r, c = np.nonzero((scores >= low[who][:, None]) & (self.ids[a:e] != ids[who][:, None]))
            some.append((who[r], a + c, scores[r, c]))
            n += len(r)
            if n >= most:
                some = best(some, 2 * k + 1, low)
                n = len(some[0][0])
        if not n:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        [(r, v, _)] = best(some, 2 * k + 1)
        [(r, v, s)] = best([(r, v, exact(q[r], self.x[v]))], k)
        return r, self.ids[v], s


def _scored(k: int, rows: int, batches):
    """Rows come by part, vectors before queries."""
    place, part = None, None
    for batch in batches:
        if not len(batch):
            continue
        names = [batch[n].to_numpy() for n in ("t", "g", "part", "kind")]
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in names], axis=0)) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            here, kind = tuple(int(x[a]) for x in names[:3]), int(names[3][a])
            if here != place:
                place, part = here, None
            if kind == 0:
                own = batch.slice(a, e - a)
                part = part or _Part()
                part.add(own["id"].to_numpy(), matrix(own["v"]), own["keys"].flatten().to_numpy())
            elif part is not None:
                for i in range(a, e, rows):
                    own = batch.slice(i, min(rows, e - i))
                    ids = own["id"].to_numpy()
                    offsets = np.concatenate([[0], np.cumsum(own["keys"].value_lengths().to_numpy())])
                    r, found, s = part.nearest(ids, matrix(own["v"]), own["keys"].flatten().to_numpy(), offsets, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(found), pa.array(s)], names=["query_id", "vec_id", "score"])


def _all_scored(q_ids, q, k: int, batches):
    """The k best of a partition for each query of the sample, with their vectors."""
    part, ids, xs = _Part(), [], []
    keep = lambda: part.nearest(q_ids, q, np.zeros(len(q), np.int64), np.arange(len(q) + 1), k)
    held = None
    for batch in batches:
        if not len(batch):
            continue
        part = _Part()
        x = matrix(batch["v"])
        part.add(batch["id"].to_numpy(), x, np.zeros(len(x), np.int64))
        r, found, s = keep()
        at = {int(i): n for n, i in enumerate(part.ids)}
        vectors = part.x[[at[int(i)] for i in found]] if len(found) else np.empty((0, q.shape[1]))
        own = (r, found, s, vectors)
        held = own if held is None else tuple(np.concatenate(c) for c in zip(held, own))
        order = np.lexsort((held[1], -held[2], held[0]))
        held = tuple(c[order] for c in held)
        rank = np.arange(len(order)) - np.searchsorted(held[0], held[0])
        held = tuple(c[rank < k] for c in held)
    if held is not None:
        r, found, s, vectors = held
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(found), pa.array(s), pa.array(list(vectors), pa.list_(pa.float64()))], names=["q", "id", "score", "v"])


def fitted(candidates: DataFrame, queries: DataFrame, size: int, rows: int, scale: float, k: int, tables: int, recall: float, sample: int) -> Hashes:
    """Hash functions for so many rows, fitted on a sample of queries and their true neighbours."""
    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by `sample`
    one = Hashes(size, scale, 1, 0, 0, 0.0, 1.0)
    if not chosen:
        return one
    ids, q = np.array([r["id"] for r in chosen]), np.array([r["v"] for r in chosen], float)
    near = candidates.mapInArrow(alone(partial(_all_scored, ids, q, k)), "q int, id long, score double, v array<double>")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    near = near.orderBy("q", "rank").collect()  # sample * k rows at most
    if not near:
        return one
    last = {r["q"]: r["score"] / (np.linalg.norm(q[r["q"]]) * scale) for r in near}
    cosine = float(np.clip(np.quantile(list(last.values()), 0.1), -0.995, 0.995))
    told = max(_BITS + math.log2(math.sqrt(1 - cosine**2)), 0.25)
    functions = int(min(math.log2(max(rows / BUCKET_ROWS, 1)) / _BITS, math.log2(PROBES) / told))
    first = int(min(functions, math.log2(max(rows * size * 8 / CHUNK_BYTES, 1)) / _BITS))
    if not functions:
        return one
    hashes = Hashes(size, scale, tables, functions, first, cosine, 0.0)
    needed = np.full(len(near), np.inf)
    x = np.array([r["v"] for r in near])
    for t in range(tables):
        keys, _ = hashes.keys(x, t)
        for i in range(len(q)):
            own = [n for n, r in enumerate(near) if r["q"] == i]
            if own:
                visited, _, sums = hashes.visits(q[i], t, 0.99)
                place = {int(b): float(s) for b, s in zip(visited, sums)}
                needed[own] = np.minimum(needed[own], [place.get(int(b), np.inf) for b in keys[own]])
    hashes.mass = float(np.quantile(needed, recall, method="higher"))
    return hashes if hashes.mass < 0.99 else one


def neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, tables: int = TABLES,
    recall: float = RECALL, sample: int = SAMPLE, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`, among all other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    stats = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("rows"), F.max(norm).alias("scale")).orderBy(F.desc("rows"), F.desc("size")).first()
    if stats is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == stats["size"])
    copies = rows.withColumn("copy", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1).drop("copy")
    candidates = written(copies, "vectors")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    hashes = fitted(candidates, queries, stats["size"], stats["rows"], stats["scale"] * (1 + 1e-12), k, tables, recall, sample)
    kind = dict(candidates.dtypes)["v"]
    schema = f"t int, g long, id long, v {kind}, keys array<long>"
    indexed = candidates.mapInArrow(alone(partial(_indexed, hashes)), schema)
    part_rows = max(1, chunk_bytes // (8 * stats["size"]))
    sizes = indexed.groupBy("t", "g").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), "parts").cast("int")
    held = indexed.join(sizes, ["t", "g"]).select("t", "g", part.alias("part"), F.lit(0).alias("kind"), "id", "v", "keys")
    asking = queries.mapInArrow(alone(partial(_visited, hashes)), schema).join(sizes, ["t", "g"])
    asking = asking.select("t", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "v", "keys")
    order = ["t", "g", "part"]
    met = held.unionByName(asking).repartition(*order).sortWithinPartitions(*order, "kind")
    found = met.mapInArrow(alone(partial(_scored, k, 512)), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
