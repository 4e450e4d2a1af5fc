"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots, bytes are summed by slot, and a small versioned map from
slot to shard places them. Rebalancing edits the map: a slot stays on its shard while that shard is under its
target, else it moves to the lightest shard. All of it is DataFrame expressions; the map has `slots` rows whatever
the data's size, so broadcasting it is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textkiln.llm.common import discard, folders, materialise, work_path, write_table

SLOTS = 8192
#: A shard keeps its own slots up to this share of the mean; the smallest slots level the rest.
KEEP_SHARE = 0.98
ROW_BYTES = 16


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and ROW_BYTES; null text: ROW_BYTES), text_crc32 (null: 0) and vslot.

    The hash takes the id and the checksum, so rows without an id or with a repeated id are spread too.
    """
    d = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return d.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_stats(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, n_bytes, n_rows; every slot has a row."""
    got = rows.groupBy("vslot").agg(F.sum("size").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(got), "vslot", "left").select("vslot", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def first_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots dealt round the shards, whatever they hold."""
    return stats.select("vslot", F.pmod("vslot", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalanced(stats: DataFrame, slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of slot_map for `shards` shards; columns vslot, shard, version, moved_from (null: stayed).

    Heaviest slots first; a shard that is no longer in range gives up all its slots. Ties go to the smaller number.
    """
    s = stats.join(F.broadcast(slot_map), "vslot").select(F.struct((-F.col("n_bytes")).alias("less"), "vslot", F.col("shard").alias("home"), "version").alias("s"))
    one = s.agg(F.sort_array(F.collect_list("s")).alias("all"), F.sum(-F.col("s.less")).alias("total"), F.max("s.version").alias("version"))
    state = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast(T.ArrayType(T.IntegerType())).alias("to"))
    target = F.col("total") * F.lit(KEEP_SHARE) / F.lit(shards)

    def place(acc: Column, x: Column) -> Column:
        lightest = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        fits = (x["home"] < shards) & (F.get(acc["load"], x["home"]) - x["less"] <= target)
        to = F.when(fits, x["home"]).otherwise(lightest)
        load = F.transform(acc["load"], lambda y, i: F.when(i == to, y - x["less"]).otherwise(y))
        return F.struct(load.alias("load"), F.concat(acc["to"], F.array(to)).alias("to"))

    out = one.select(F.explode(F.arrays_zip("all", F.aggregate("all", state, place)["to"].alias("to"))).alias("z"), "version")
    shard, home = F.col("z.to"), F.col("z.all.home")
    return out.select(F.col("z.all.vslot").alias("vslot"), shard.alias("shard"), (F.col("version") + 1).alias("version"), F.when(shard != home, home).alias("moved_from"))


MAP = "vslot int, shard int, version int, first long"


def stored_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the map that is kept under path; None where there is none yet."""
    kept = [x for x in folders(spark, path) if x.startswith("version-")]
    return spark.read.schema(MAP).parquet(f"{path}/{kept[-1]}") if kept else None


def placed(docs: DataFrame, shards: int = 40, slots: int = SLOTS, slot_map: DataFrame | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, size, text_crc32, shard, place, vslot, version) and the map that placed them, as stored.

    Maps are kept under path, a folder a version. A call loads the newest one (or takes slot_map, a map that an earlier
    call has returned), edits it for the sizes as they are now and stores the next version there; older ones stay.
    Without path the map lives as long as the session. slot_map must hold every slot once.

    Shards get nearly equal bytes. Places are gapless from 0 in a shard: a slot's first place follows from the counts
    in the map, a row's place in its slot from its order by id, so no task sorts more than a slot. Equal rows get places
    in any order. An empty table gives no rows; columns beyond doc_id and text are not read.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "slot-map")
    if slot_map is None:
        slot_map = stored_map(spark, path)
    rows = sized(docs, slots)
    stats = materialise(slot_stats(rows, slots), "slot-stats")
    if slot_map is None:
        slot_map = first_map(stats, shards)
    elif slot_map.count() != slots or slot_map.filter(F.col("vslot").between(0, slots - 1)).select("vslot").distinct().count() != slots:
        raise ValueError(f"the map doesn't hold each of {slots} slots once")
    new = rebalanced(stats, slot_map.select("vslot", "shard", "version"), shards)
    start = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("n_rows")
    version = slot_map.agg(F.max("version")).first()[0] + 1
    kept = write_table(new.join(F.broadcast(stats), "vslot").select("vslot", "shard", "version", start.alias("first")), f"{path}/version-{version:09d}")
    discard(stats)
    in_slot = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("in_slot", in_slot).join(F.broadcast(kept), "vslot").withColumn("place", F.col("first") + F.col("in_slot")).drop("first", "in_slot")
    return out, kept


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """The rows of `placed`."""
    return placed(docs, shards, slots, path=path)[0]
