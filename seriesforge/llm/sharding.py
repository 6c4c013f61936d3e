"""Sharding through fixed virtual slots (DataFrame operations only).

Records are hashed into thousands of virtual slots, bytes are summed per slot, and a versioned
map says which shard holds each slot. Rebalancing edits the map: version 0 deals the slots out in
turn, each later version moves single slots from the fullest to the emptiest shard until no move
brings them nearer. Only the map, whose length is the number of slots, ever reaches the driver.

Defined results: a null text has 8 bytes and the CRC-32 of an empty one; rows with a null doc_id
are spread by their text; equal rows have places of their own; an empty table gives no rows; a very long
text weighs in one slot. Equal texts are no group here: copies go where their doc_id sends them, as a
group may hold a third of all rows, which no shard could take under the law. Only the columns in
``keep`` come through.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir

N_SHARDS = 24
N_SLOTS = 8192


@dataclass
class SlotMap:
    """The versions of a slot-to-shard map, kept as a table (version, slot, shard, bytes, rows)."""

    spark: SparkSession
    path: str

    def versions(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def latest(self) -> DataFrame:
        all_of = self.versions()
        return all_of.where(F.col("version") == all_of.agg(F.max("version")).first()[0])

    def store(self, version: int, shards: list[int], totals: dict[int, tuple[int, int]]) -> None:
        rows = [{"version": version, "vslot": slot, "shard": shard, "slot_bytes": totals.get(slot, (0, 0))[0], "slot_rows": totals.get(slot, (0, 0))[1]} for slot, shard in enumerate(shards)]
        schema = "array<struct<version int, vslot int, shard int, slot_bytes long, slot_rows long>>"
        one = self.spark.range(1).coalesce(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
        one.write.mode("append").parquet(self.path)


def rebalance(shards: list[int], load: list[int], n_shards: int) -> list[int]:
    """The map with slots moved from the fullest to the emptiest shard, one at a time, until no move brings
    them nearer. Every move lowers the sum of the squared loads, so there is a last one."""
    shards = list(shards)
    total, held = [0] * n_shards, [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shards):
        total[shard] += load[slot]
        if load[slot]:
            held[shard].append(slot)
    while True:
        full = max(range(n_shards), key=lambda s: (total[s], -s))
        empty = min(range(n_shards), key=lambda s: (total[s], s))
        gap = total[full] - total[empty]
        slot = min((s for s in held[full] if load[s] < gap), key=lambda s: (abs(2 * load[s] - gap), s), default=None)
        if slot is None:
            return shards
        held[full].remove(slot)
        held[empty].append(slot)
        total[full] -= load[slot]
        total[empty] += load[slot]
        shards[slot] = empty


def _records(docs: DataFrame, n_slots: int, keep: tuple[str, ...] = ()) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        *keep,
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law (``bytes``), shard, slot (its place in
    the shard, from 0 without gaps), grown_shard (null under this law), vslot, map_version, and the columns in ``keep``.

    Shards have nearly equal bytes: the fullest and the emptiest differ by less than the smallest
    virtual slot of the fullest.
    """
    spark = docs.sparkSession
    records = materialise(_records(docs, n_slots), "records")
    sums = records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # n_slots rows at most
    totals = {r.vslot: (r.b, r.n) for r in sums}
    slots = SlotMap(spark, path or f"{shared_dir(spark)}/slot_map")
    dealt = [slot % n_shards for slot in range(n_slots)]
    slots.store(0, dealt, totals)
    slots.store(1, rebalance(dealt, [totals.get(s, (0, 0))[0] for s in range(n_slots)], n_shards), totals)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    where = slots.latest().select("vslot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        (_records(docs, n_slots, keep) if keep else records)
        .withColumn("place", place)
        .join(F.broadcast(where), "vslot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version", *keep,
        )
    )
