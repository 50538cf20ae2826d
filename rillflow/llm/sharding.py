"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of slots, bytes are summed per slot, and a versioned
slot-to-shard map says where a slot lives. Only the map is edited to rebalance or to add a shard;
records never hash anew. The map has `n_slots` rows whatever the input, so it is broadcast.

The slot comes from a hash of key and text, so the records of one key are spread. Records equal in both
are one row with a count, cut into chunks of about `CHUNK_BYTES` that hash apart; each chunk becomes
records again when they are numbered. So a key, or a record, with a third of all rows is no single slot
and no single task.

Edge cases: a null text has size 1 (no bytes, plus 1) and counts as another text than an empty one; equal
records are numbered one by one, in no order that could be told; a null key hashes like any value; an empty
table gives a map in which all slots have 0 bytes, and no rows. Only key and text are read; what else a
table has, whatever its name, is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

N_SLOTS = 4096
CHUNK_BYTES = 1 << 16
MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("virtual_slot", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("shard", T.IntegerType()),
    ]
)


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def chunks(df: DataFrame, key: str, text: str, n_slots: int = N_SLOTS) -> DataFrame:
    """key, size, text_crc32, mark (hash of the text), chunk, n (equal records in the chunk), virtual_slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    records = df.select(
        F.col(key).alias("key"), record_size(F.col(text)).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body, F.col(text).isNull()).alias("mark")
    )
    equal = records.groupBy("key", "mark", "text_crc32", "size").agg(F.count("*").alias("all"))
    most = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(CHUNK_BYTES) / F.col("size")))
    cut = equal.withColumn("most", most).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / F.col("most")))))
    n = F.least(F.col("most"), F.col("all") - F.col("chunk") * F.col("most"))
    slot = F.pmod(F.xxhash64("key", "mark", "chunk"), F.lit(n_slots)).cast("int")
    return cut.select("key", "size", "text_crc32", "mark", "chunk", n.alias("n"), slot.alias("virtual_slot"))


def slot_bytes(slotted: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """One row per virtual slot, empty slots included: virtual_slot, bytes, records."""
    all_slots = slotted.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = slotted.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("records"))
    return all_slots.join(F.broadcast(sums), "virtual_slot", "left").na.fill(0, ["bytes", "records"])  # n_slots rows


def _place(sums: DataFrame, start: Column, version: int) -> DataFrame:
    """Folds over the slots, largest first, giving each to the shard with the fewest bytes so far."""
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), F.col("virtual_slot").alias("v"))))

    def step(acc, x):
        at = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        load = F.transform(acc["load"], lambda b, i: F.when(i == at, b - x["neg"]).otherwise(b))
        return F.struct(load.alias("load"), F.concat(acc["to"], F.array(at)).alias("to"))

    start = F.struct(start.alias("load"), F.array().cast("array<int>").alias("to"))
    folded = sums.agg(in_order.alias("s")).select("s", F.aggregate("s", start, step)["to"].alias("to"))
    placed = folded.select(F.explode(F.arrays_zip("s", "to")).alias("x"))
    return placed.select(
        F.lit(version).cast("int").alias("version"),
        F.col("x.s.v").alias("virtual_slot"),
        (-F.col("x.s.neg")).alias("bytes"),
        F.col("x.to").alias("shard"),
    )


def first_map(sums: DataFrame, n_shards: int) -> DataFrame:
    """Version 1: every slot goes to the shard that holds the fewest bytes, the largest slots first."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    return _place(sums, F.array_repeat(F.lit(0).cast("long"), n_shards), 1)


def grow_map(slot_map: DataFrame, sums: DataFrame, n_shards: int) -> DataFrame:
    """The next version with shard number n_shards added: slots move only into the new shard.

    Each old shard gives up its smallest slots, up to 1/(n_shards+1) of its own bytes.
    """
    now = slot_map.drop("bytes").join(F.broadcast(sums.select("virtual_slot", "bytes")), "virtual_slot")
    w = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    total = F.sum("bytes").over(Window.partitionBy("shard"))
    moved = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) * (n_shards + 1) <= total
    return now.select(
        (F.col("version") + 1).cast("int").alias("version"),
        "virtual_slot",
        "bytes",
        F.when(moved & (F.col("bytes") > 0), F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def store_map(slot_map: DataFrame, at: str, version: int) -> DataFrame:
    """Appends a version, given by its number, to the map table and reads it back."""
    slot_map.coalesce(1).write.mode("append").parquet(at)
    return load_map(slot_map.sparkSession, at, version)


def load_map(spark, at: str, version: int | None = None) -> DataFrame:
    """One stored version of the map, the latest by default."""
    table = spark.read.schema(MAP_SCHEMA).parquet(at)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version)


def assign(slotted: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds each chunk's shard; the map has a fixed number of rows, so no record is shuffled."""
    return slotted.drop("shard").join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot", "left")


def number_rows(assigned: DataFrame, sums: DataFrame, slot_map: DataFrame) -> DataFrame:
    """A row for each record, with `slot`: the record's place in its shard, 0, 1, 2 and so on without gaps.

    Records are numbered inside their virtual slot by (key, mark), then shifted by the counts of the shard's
    earlier virtual slots (from `sums`, the rows of slot_bytes), so no task ever holds a whole shard.
    """
    per_slot = slot_map.select("virtual_slot", "shard").join(F.broadcast(sums.select("virtual_slot", "records")), "virtual_slot")  # n_slots rows
    before = per_slot.select(
        "virtual_slot",
        (F.sum("records").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("records")).alias("before"),
    )
    w = Window.partitionBy("virtual_slot").orderBy(F.col("key").asc_nulls_first(), "mark", "text_crc32", "size", "chunk")
    placed = assigned.withColumn("first", F.sum("n").over(w) - F.col("n")).join(F.broadcast(before), "virtual_slot")
    within = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return placed.withColumn("i_", within).withColumn("slot", F.col("before") + F.col("first") + F.col("i_")).drop("before", "first", "i_", "n", "chunk")
