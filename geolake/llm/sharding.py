"""Sharding through fixed virtual slots.

A record's id is hashed into one of thousands of virtual slots, and a small versioned map sends slots to shards. The map
depends on the number of slots and shards alone, so the id and the shard count decide (law `key`); growing by one shard
edits the map by handing the newcomer an equal part of each old shard's slots, and no other slot moves. Rows and bytes are
aggregated per slot and stored beside each version of the map in the shared folder; `rebalance` edits a map from them where
sizes must be evened out, at the price of the law.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SLOTS = 4096


def virtual_slot(doc_id: Column, crc: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the id's MD5 modulo the slots. A null id is keyed by the text's checksum, so such rows spread."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), crc.cast("string")))
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def grown_owners(owners: list[int]) -> list[int]:
    """One shard more: it takes the last slots of whichever shard holds most, up to its equal part; no other slot moves."""
    new = max(owners, default=-1) + 1
    held: list[list[int]] = [[] for _ in range(new)]
    for v, s in enumerate(owners):
        held[s].append(v)
    out = list(owners)
    for _ in range(len(owners) // (new + 1)):
        out[max(held, key=len).pop()] = new
    return out


def slot_owners(shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: from one shard, grown by one at a time."""
    owners = [0] * slots
    for _ in range(shards - 1):
        owners = grown_owners(owners)
    return owners


def slot_map(spark: SparkSession, shards: int, slots: int = SLOTS, version: int | None = None) -> DataFrame:
    """The map as a table (version, vslot, shard) of `slots` rows; its version is the shard count unless given."""
    rows = [(version or shards, v, s) for v, s in enumerate(slot_owners(shards, slots))]
    return spark.createDataFrame(rows, "version int, vslot int, shard int")


def grow(current: DataFrame) -> DataFrame:
    """The next version of a map (version, vslot, shard), edited for one shard more; a map has a fixed number of rows."""
    rows = sorted((r["vslot"], r["shard"], r["version"]) for r in current.select("vslot", "shard", "version").collect())
    return current.sparkSession.createDataFrame([(v[2] + 1, v[0], s) for v, s in zip(rows, grown_owners([r[1] for r in rows]))], "version int, vslot int, shard int")


def slot_sizes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of each virtual slot: (vslot, rows, bytes), at most `slots` rows."""
    d = _sized(docs).withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots))
    return sizes_of(d)


def sizes_of(sized: DataFrame) -> DataFrame:
    return sized.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def rebalance(current: DataFrame, sizes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """A next version of the map, with slots taken from shards over the mean by more than `tolerance`.

    In every overfull shard the slots beyond the mean leave, in slot order; shards with room take them by their share of
    the room. Works on the map alone, so its size is the number of slots.
    """
    m = current.join(sizes, "vslot", "left").fillna(0, ["bytes", "rows"])
    w = Window.partitionBy("shard").orderBy("vslot")
    per = m.groupBy("shard").agg(F.sum("bytes").alias("held"))
    mean = per.agg(F.avg("held")).first()[0] or 0.0
    m = m.withColumn("upto", F.sum("bytes").over(w)).withColumn("leaves", F.col("upto") > mean * (1 + tolerance))
    room = per.where(F.col("held") < mean).select("shard", (F.lit(mean) - F.col("held")).alias("room"))
    room = room.withColumn("hi", F.sum("room").over(Window.orderBy("shard"))).withColumn("lo", F.col("hi") - F.col("room"))
    off = m.where("leaves").withColumn("point", F.sum("bytes").over(Window.orderBy("vslot")) - F.col("bytes") / 2)
    to = off.alias("o").join(F.broadcast(room.alias("r")), (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")), "left")
    moved = to.select("version", "vslot", F.coalesce("r.shard", "o.shard").alias("shard"))
    return m.where(~F.col("leaves")).select("version", "vslot", "shard").unionByName(moved).withColumn("version", F.col("version") + 1)


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version, slot_bytes for every row.

    size: UTF-8 bytes and one more (null text: 1). slot: the record's place in its shard, gapless from 0, in the order of
    virtual slot, doc_id, checksum, size; equal rows take neighbouring places. grown_shard: the shard in the next version of
    the map, with one shard more. slot_bytes: the sizes of the virtual slot's rows in sum. Columns other than doc_id and text are not
    read. An empty table gives an empty result. Only ids, sizes and checksums are shuffled, never texts; ranks are taken
    inside a virtual slot and moved up by the counts of the slots before it, so no task holds a shard.
    """
    spark = docs.sparkSession
    d = _sized(docs).withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots))
    ranked = stored(d.withColumn("rank", F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1), "shards")
    # both versions of the map with the sizes of their slots, as they are kept for the next rebalancing: at most `slots` rows each
    now = slot_map(spark, shards, slots)
    maps = stored(now.unionByName(grow(now)).join(F.broadcast(sizes_of(ranked)), "vslot", "left").fillna(0, ["rows", "bytes"]).coalesce(1), "slot_map")
    m = maps.where(F.col("version") == shards).withColumn("base", F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows"))
    m = m.join(maps.where(F.col("version") == shards + 1).select("vslot", F.col("shard").alias("grown_shard")), "vslot")
    return ranked.join(F.broadcast(m), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), "grown_shard", "vslot",
        F.col("version").alias("map_version"), F.col("bytes").alias("slot_bytes"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
