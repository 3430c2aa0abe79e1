"""An index for vector search: vectors in cells around centroids, as a table partitioned by cell.

Centroids are fitted by k-means on a sample of SAMPLE vectors (a parameter); every vector is then put into the cell of its nearest centroid. A search
reads the cells whose centroids are nearest to the query, as a filter on the partition column, and scores what it finds exactly.
How many cells that takes is measured when the index is made: a sample of vectors is searched in all of them, and `probes` is what
RECALL of their true neighbours need. `probes=None` asks for all cells: the search is exact then.

Bounds. There are MOST_CELLS centroids at most, so they fit on the driver and are sent out; a cell with more than `part_rows` vectors is
dealt to parts by a hash of the id, and a task holds one part at a time. Queries of a batch are rows: they meet the parts that they
visit in one shuffle, never on the driver. Small cells meet them in groups of about `part_rows` vectors: a query goes to a group once, with the names
of the cells that it visits there, and an exact search takes no notice of cells. Python makes tables of scores of SCORES entries at most.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import pieces
from ..functions.vectors import rows_dot, usable

SAMPLE, MOST_CELLS, CELL_ROWS, PART_ROWS = 16_384, 4096, 256, 16_384
SCORES, SENT_ROWS = 1 << 20, 8192
RECALL, ASKED, NEAR = 0.95, 128, 10


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step = max(1, SCORES // len(centroids))
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + step] @ centroids.T).argmax(axis=1) for i in range(0, len(x), step))])


def centroids_of(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k-means on unit vectors, by cosine."""
    sample = units(sample)
    rng = np.random.default_rng(seed)
    out = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        own = nearest_centroid(sample, out)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        filled = np.bincount(own, minlength=cells) > 0
        out = np.where(filled[:, None], units(sums), out)
    return out


def groups_of(sizes: list[int], parts: list[int], part_rows: int) -> tuple[list[int], list[int]]:
    """Each cell's group, and each group's number of parts: cells of one part stand together while they have `part_rows` vectors at most."""
    group, many, held = [], [], None
    for n, p in zip(sizes, parts):
        if p > 1 or held is None or held + n > part_rows:
            many.append(p)
            held = None if p > 1 else 0
        group.append(len(many) - 1)
        if held is not None:
            held += n
    return group, many


def _placed(centroids: np.ndarray, batches):
    for batch in pieces(batches):
        cell = nearest_centroid(units(matrix(batch["v"])), centroids)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])


def _asked(centroids: np.ndarray, group: np.ndarray, probes: int, batches):
    """Each query in the groups of its nearest cells: `cell` is the group, `cells` are those of its cells that are in it, `near` the nearest of all."""
    for batch in pieces(batches, max(1, SCORES // len(centroids))):
        near = np.argsort(-(units(matrix(batch["v"])) @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
        first = near[:, 0].copy()
        order = np.argsort(group[near], axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1).ravel()
        row, own = np.repeat(np.arange(len(batch)), order.shape[1]), group[near]
        starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(own) != 0)])
        ends = np.r_[starts[1:], len(near)]
        for i in range(0, len(starts), SENT_ROWS):
            a, e = starts[i : i + SENT_ROWS], ends[i : i + SENT_ROWS]
            cells = pa.ListArray.from_arrays(pa.array(np.r_[a, e[-1]] - a[0], pa.int32()), pa.array(near[a[0] : e[-1]]))
            own_rows = batch.take(pa.array(row[a]))
            yield pa.RecordBatch.from_arrays([*own_rows.columns, pa.array(own[a].astype(np.int32)), cells, pa.array(first[row[a]])], names=[*batch.schema.names, "cell", "cells", "near"])


class _Held:
    """The vectors of a part, in the order of their ids. Of equal ones in a cell the first k are kept: no others can be among k nearest."""

    def __init__(self, k: int):
        self.k, self.ids, self.rows, self.cells, self.ready = k, [], [], [], False

    def add(self, ids, v, cells):
        self.ids.append(ids)
        self.rows.append(units(matrix(v)))
        self.cells.append(cells.to_numpy())

    def _sorted(self):
        ids, x, cells = pa.chunked_array(self.ids), np.concatenate(self.rows), np.concatenate(self.cells)
        order = pc.sort_indices(ids).to_numpy()
        named = np.ascontiguousarray(np.c_[x, cells][order]).view(np.dtype((np.void, (x.shape[1] + 1) * 8))).ravel()
        same = np.unique(named, return_inverse=True)[1]
        by = np.argsort(same, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by)) - np.searchsorted(same[by], same[by])
        order = order[place < self.k]
        self.ids, self.x, self.rows, self.ready = ids.take(pa.array(order)).combine_chunks(), x[order], [], True
        self.cells, self.own = np.unique(cells[order], return_inverse=True)

    def best(self, batch, k: int):
        """(query row, place among the ids, score) of the k most similar, ties by id. Products of matrices round as they like: they choose a few
        more, and sums taken in one order decide."""
        q, places, asked = units(matrix(batch["v"])), slice(None), batch["cells"]
        met = None
        if asked.null_count < len(asked):  # queries name the cells that they visit
            row, cell = np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()
            at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            here = self.cells[at] == cell
            met = np.zeros((len(q), len(self.cells)), bool)
            met[row[here], at[here]] = True
            places = np.flatnonzero(met.any(axis=0)[self.own])
            met = met[:, self.own[places]]
        x = self.x[places]
        scores = q @ x.T
        if met is not None:
            scores[~met] = -np.inf
        if scores.shape[1] > k:
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] - 1e-12
            r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        else:
            r, c = np.nonzero(scores > -np.inf)
        s = np.concatenate([np.zeros(0), *(rows_dot(q[r[i : i + SENT_ROWS]], x[c[i : i + SENT_ROWS]]) for i in range(0, len(r), SENT_ROWS))])
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[kept], c[kept] if met is None else places[c[kept]], s[kept]


def _met(k: int, batches):
    """Rows come by cell and part, vectors before queries."""
    place, held = None, None
    for batch in pieces(batches, SENT_ROWS):
        names = [batch[n].to_numpy() for n in ("cell", "part", "kind")]
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in names], axis=0)) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            here, own = (int(names[0][a]), int(names[1][a])), batch.slice(a, e - a)
            if here != place:
                place, held = here, None
            if names[2][a] == 0:
                held = held or _Held(k)
                held.add(own["id"], own["v"], own["near"])
            elif held is not None:
                if not held.ready:
                    held._sorted()
                rows = max(1, SCORES // len(held.x))
                for i in range(0, e - a, rows):
                    some = own.slice(i, rows)
                    r, c, s = held.best(some, k)
                    yield pa.RecordBatch.from_arrays([some["query_id"].take(pa.array(r)), held.ids.take(pa.array(c)), pa.array(s)], names=["query_id", "id", "score"])


def nearest_in_parts(held: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) by cosine. held: (cell, part, id, v, near), asking: (cell, part, query_id, v, cells, near), a row a part that a query visits.
    `near` of a vector is compared with `cells` of a query, which are null if it takes all; queries of like `near` come together."""
    ids, asks = dict(held.dtypes)["id"], dict(asking.dtypes)["query_id"]
    none = lambda kind: F.lit(None).cast(kind)
    v = F.col("v").cast("array<double>").alias("v")
    vectors = held.select("cell", "part", F.lit(0).alias("kind"), "near", "id", none(asks).alias("query_id"), v, none("array<int>").alias("cells"))
    queries = asking.select("cell", "part", F.lit(1).alias("kind"), "near", none(ids).alias("id"), "query_id", v, "cells")
    met = vectors.unionByName(queries).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "near")
    found = met.mapInArrow(partial(_met, k), f"query_id {asks}, id {ids}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "score", F.col("rank").cast("int").alias("rank"))


def blocks_of(rows: DataFrame, parts: int) -> DataFrame:
    """rows (id, v) dealt to parts by a hash of the id, all in one cell."""
    return rows.select(F.lit(0).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v", F.lit(0).alias("near"))


def in_all(queries: DataFrame, parts: int) -> DataFrame:
    part, cells = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("array<int>").alias("cells")
    return queries.select(F.lit(0).alias("cell"), part, "query_id", "v", cells, F.lit(0).alias("near"))


def _by(values: list[int], key: str) -> Column:
    """values[key] as a column, without a list in the plan if all are the same."""
    return F.array(*map(F.lit, values))[F.col(key)] if len(set(values)) > 1 else F.lit(values[0])


class VectorIndex:
    """path/cells: the cells' centroids, sizes and probes. path/vectors: cell, part, id, v and the columns that were carried along."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._model: dict | None = None

    @classmethod
    def build(
        cls, vectors: DataFrame, path: str, id_col: str, vector: str = "embedding", carried: tuple[str, ...] = (), cells: int | None = None, sample: int = SAMPLE,
        cell_rows: int = CELL_ROWS, part_rows: int = PART_ROWS, recall: float = RECALL, asked: int = ASKED, near: int = NEAR,
    ) -> VectorIndex:
        """Writes an index into a folder that holds none. Vectors that are null, zero or not finite, or whose length isn't the most frequent one, are left out."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), *carried).where(F.col("id").isNotNull() & usable("v"))
        stats = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
        size, n = (stats["size"], stats["rows"]) if stats else (1, 0)
        rows = rows.where(F.size("v") == size)
        chosen = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by `sample`
        cells = max(1, min(cells or n // cell_rows, MOST_CELLS, len(chosen)))
        points = np.array([r["v"] for r in chosen], float).reshape(len(chosen), size)
        centroids = centroids_of(points, cells) if len(points) else np.zeros((1, size))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        placed = rows.mapInArrow(partial(_placed, centroids), f"{kinds}, cell int")
        sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MOST_CELLS rows at most
        parts = [max(1, -(-sizes.get(c, 0) // part_rows)) for c in range(cells)]
        placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), _by(parts, "cell")).cast("int"))
        placed.repartition("cell", "part").sortWithinPartitions("cell", "part", "id").write.partitionBy("cell").parquet(f"{path}/vectors")
        index = cls(spark, path)
        probes, columns = cells, f"{kinds}, part int, cell int"
        if cells > 1:
            first = chosen[:asked]
            sought = spark.createDataFrame([(i, [float(x) for x in r["v"]]) for i, r in enumerate(first)], "query_id int, v array<double>")
            index._model = {"centroids": centroids, "sizes": [sizes.get(c, 0) for c in range(cells)], "parts": parts, "probes": cells, "columns": columns}
            found = index.search_batch(sought, near, probes=None).join(index.vectors().select("id", "cell"), "id").collect()  # asked * near rows
            order = np.argsort(-(units(points[: len(first)]) @ centroids.T), axis=1, kind="stable")
            place = order.argsort(axis=1)
            probes = int(np.quantile([place[r["query_id"], r["cell"]] for r in found], recall, method="higher")) + 1
        told = [(c, centroids[c].tolist(), sizes.get(c, 0), parts[c], probes, columns) for c in range(cells)]
        spark.createDataFrame(told, "cell int, centroid array<double>, n long, parts int, probes int, columns string").coalesce(1).write.parquet(f"{path}/cells")
        index._model = None
        return index

    def _read(self) -> dict:
        if self._model is None:
            rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
            lists = {"centroids": np.array([r["centroid"] for r in rows]), "sizes": [r["n"] for r in rows], "parts": [r["parts"] for r in rows]}
            self._model = lists | {n: rows[0][n] for n in ("probes", "columns")}
        return self._model

    @property
    def probes(self) -> int:
        return self._read()["probes"]

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self._read()["columns"]).parquet(f"{self.path}/vectors")

    def near(self, query, probes: int | None = 0) -> DataFrame:
        """The rows of the cells that one query visits: `probes` cells, as many as the index has found to need (0), or all (None)."""
        model = self._read()
        if probes is None:
            return self.vectors()
        order = np.argsort(-(model["centroids"] @ np.asarray(query, float)), kind="stable")[: probes or model["probes"]]
        return self.vectors().where(F.col("cell").isin(order.tolist()))

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = 0, group_rows: int = PART_ROWS) -> DataFrame:
        """(query_id, id, score, rank) for queries (query_id, v), each in the cells it visits. Small cells stand together in groups of `group_rows` vectors."""
        model = self._read()
        queries = queries.select("query_id", "v").where(usable("v") & (F.size("v") == model["centroids"].shape[1]))
        if probes is None:
            parts = max(1, -(-sum(model["sizes"]) // group_rows))
            return nearest_in_parts(blocks_of(self.vectors(), parts), in_all(queries, parts), k)
        group, many = groups_of(model["sizes"], model["parts"], group_rows)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
        asked = partial(_asked, model["centroids"], np.array(group), probes or model["probes"])
        asking = queries.mapInArrow(asked, f"{kinds}, cell int, cells array<int>, near int")
        asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), _by(many, "cell") - 1)))
        held = self.vectors().select(_by(group, "cell").alias("cell"), "part", "id", "v", F.col("cell").alias("near"))
        return nearest_in_parts(held, asking, k)
