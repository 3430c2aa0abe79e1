"""Sharding by fixed virtual slots and a versioned slot-to-shard map. DataFrame operations only.

Each record is hashed into one of `n_slots` virtual slots (a fixed number, thousands), bytes and rows
are summed per slot with partial aggregation, and a map assigns whole slots to shards. The map is the
only thing edited when shards are added or sizes drift: a new version moves as few slots as needed.
Its size is bounded by `n_slots`, whatever the data, so it may be held by the driver and broadcast.

Records are told apart by id and text. Rows that repeat both would fill one slot whatever their number: they are counted, and dealt
over the slots by their place in the table, which is then written first, so that sizes and rows agree.

Defined results: null text counts as empty; a null id is the id "null" of its own kind and stands last in its slot; rows that repeat
id and text are spread over the slots and follow each other in any order, being equal; an empty table gives an
empty result and a map of empty slots; other columns pass through untouched, but those named like a result
(size, text_crc32, vslot, shard, slot) are replaced by it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import work_path, written

N_SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int, slot_bytes long, slot_rows long"


def _slot(n_slots: int, *parts):
    key = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).cast("binary"))
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(n_slots)).cast("int")


def with_slots(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Adds size, text_crc32 and vslot. The hash is of id and text, and for rows that repeat both of their place."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select("*", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    key, crc = F.col(id_col), F.col("text_crc32")
    repeats = written(out.groupBy(key.alias("_id"), crc.alias("_crc")).agg(F.count("*").alias("_n")).where("_n > 1"), "repeated-rows")
    plain = out.select("*", _slot(n_slots, key, crc, F.lit(0)).alias("vslot"))
    if not repeats.take(1):
        return plain
    joined = out.join(repeats, key.eqNullSafe(F.col("_id")) & (crc == F.col("_crc")), "left")
    place = F.when(F.col("_n") > 1, F.monotonically_increasing_id()).otherwise(F.lit(0))
    return written(joined.select(*out.columns, _slot(n_slots, key, crc, place).alias("vslot")), "slots")


def slot_sizes(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot; at most one row for each of the fixed number of slots reaches the driver."""
    got = slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("r")).collect()
    return {x["vslot"]: (x["b"], x["r"]) for x in got}


def build_map(sizes: dict[int, tuple[int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Version 1: slots in descending order of bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for slot in sorted(range(n_slots), key=lambda x: (-sizes.get(x, (0, 0))[0], x)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, (0, 0))[0], shard))
    return out


def rebalance(slots: dict[int, int], sizes: dict[int, tuple[int, int]], n_shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """An edited map: moves slots from shards above the mean to those below, until all are within the tolerance.

    A grown number of shards starts with empty shards, which take slots from the others only.
    """
    out = dict(slots)
    weight = {s: sizes.get(s, (0, 0))[0] for s in slots}
    load = dict.fromkeys(range(n_shards), 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(n_shards)}
    for slot, shard in out.items():
        load[shard] += weight[slot]
        heapq.heappush(held[shard], (-weight[slot], slot))
    mean = sum(load.values()) / n_shards
    givers = sorted(load, key=lambda s: -load[s])
    for giver in givers:
        passed = []
        while load[giver] > mean * (1 + tolerance) and held[giver]:
            taker = min(load, key=lambda s: (load[s], s))
            w, slot = heapq.heappop(held[giver])
            if taker == giver or load[taker] - w > max(load[giver] + w, mean * (1 + tolerance)):
                passed.append((w, slot))  # too large to help
                continue
            out[slot] = taker
            load[giver] += w
            load[taker] -= w
            heapq.heappush(held[taker], (w, slot))
        for x in passed:
            heapq.heappush(held[giver], x)
    return out


def store_map(spark: SparkSession, slots: dict[int, int], sizes: dict[int, tuple[int, int]], path: str, version: int) -> None:
    """Writes one version of the map as `path`/version=N; versions are never overwritten."""
    rows = [(version, k, s, *map(int, sizes.get(k, (0, 0)))) for k, s in sorted(slots.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/v{version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{version:06d}")


def edited_map(spark: SparkSession, path: str, version: int, n_shards: int, tolerance: float = 0.01) -> DataFrame:
    """The next version of a stored map, for n_shards shards: few slots move, the rows of the others stay where they are."""
    rows = load_map(spark, path, version).collect()  # a row for each of the fixed number of slots
    sizes = {r["vslot"]: (r["slot_bytes"], r["slot_rows"]) for r in rows}
    store_map(spark, rebalance({r["vslot"]: r["shard"] for r in rows}, sizes, n_shards, tolerance), sizes, path, version + 1)
    return load_map(spark, path, version + 1)


def with_shards(slotted: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds shard and slot, the row's place in its shard (gapless from 0, by virtual slot, then id).

    The window runs per virtual slot, so no task ever holds a whole shard; the offsets of the slots within
    their shards come from the map, which already has the row counts.
    """
    offsets = slot_map.select(
        "vslot",
        "shard",
        F.coalesce(
            F.sum("slot_rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
    )
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col(id_col).asc_nulls_last(), "text_crc32"))
    placed = slotted.withColumn("_rank", rank).join(F.broadcast(offsets), "vslot")
    return placed.withColumn("slot", F.col("_before") + F.col("_rank") - 1).drop("_before", "_rank")


def shard_table(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with size, text_crc32, vslot, shard and slot. Version 1 of the map is stored under map_path."""
    spark = docs.sparkSession
    taken = {"size", "text_crc32", "vslot", "shard", "slot", "_before", "_rank"}
    slotted = with_slots(docs.drop(*taken), id_col, text_col, n_slots)
    sizes = slot_sizes(slotted)
    path = map_path or work_path(spark, "slot-map")
    store_map(spark, build_map(sizes, n_shards, n_slots), sizes, path, 1)
    return with_shards(slotted, load_map(spark, path, 1), id_col)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes the rows as `path`/shard=N; a virtual slot is the unit of a task, so a large shard has many files."""
    sharded.repartition("vslot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_table(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
