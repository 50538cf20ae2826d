"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from weights, no source above `max_repeats` times its own size. The mix is cut into
blocks of equal token counts; the blocks are seats, dealt to sources by the highest quotients
target / (2j - 1). Seat numbers also cut the mix into output shards, each with an integer quota of blocks
of every source. A source's documents stand in a seeded order, read over again for further passes; shard
after shard takes its quota of blocks from there, so what a document gives, and to which shards, follows
from the quotas alone (`taken` and `parts`).

No seat is enumerated: the seats that every divisor near the right one gives are counted, and only
about two per source around the boundary are ranked. Documents get their token offset within a
source by summing over (source, hash slice) first; slices follow the number of documents, so a source with
a third of all rows is spread over them.

Edge cases: null text has size 0 and takes 0 tokens; a null source is a source of its own, ordered
last; repeated rows count one by one, rows of equal key and size in the order of `ties`; an empty table
gives no rows; a source of size 0 gets target 0. Input columns are kept but for the names that the result
adds (`source_size`, `target`, `taken`, `parts`) and h_, slice_, ends_, at_, s_, k_, q_, tokens_ and shards_.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_TOKENS = 1024
BLOCKS_PER_SOURCE = 1000
N_SHARDS = 16
ROWS_PER_SLICE, LEAST_SLICES = 200_000, 64


def source_sizes(sized: DataFrame) -> DataFrame:
    """source, source_size, source_rows: one row per source."""
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))


def weights(sizes: DataFrame, cycle: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight: the cycle repeated over the sources in code-point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picked = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int"))
    return sizes.withColumn("place", rank).withColumn("weight", picked.cast("double"))


def targets(weighted: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds target: shares by weight of all tokens, capped, the excess reshared by weight.

    Sorted by size per weight, the capped sources are a prefix: source i is capped when the tokens
    left after the caps before it, shared by the weights left, exceed its cap. One pass finds them.
    """
    full = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * max_repeats
    left_tokens = F.sum("source_size").over(full) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    left_weight = F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    with_caps = weighted.withColumn("cap", cap).withColumn("capped", left_tokens * F.col("weight") > cap * left_weight)
    free_tokens = F.sum("source_size").over(full) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(full)
    free_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(full)
    return with_caps.withColumn(
        "target",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free_tokens * F.col("weight") / free_weight),
    )


def seats(targeted: DataFrame, houses: list[int]) -> DataFrame:
    """Sainte-Laguë seats of each source for every house size: columns of targeted, nth (of houses), house, seats.

    The rows grow with sources times houses, not with seats.
    """
    sizes = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(h).cast("long").alias("house")) for i, h in enumerate(houses)])
    both = targeted.withColumn("h_", F.explode(sizes)).select(*targeted.columns, "h_.nth", "h_.house")
    w = Window.partitionBy("nth")
    total, n = F.sum("target").over(w), F.count(F.when(F.col("target") > 0, 1)).over(w)
    low = F.greatest(F.lit(0.0), (F.col("house") - n / 2 - 1) / F.col("total"))
    high = (F.col("house") + n / 2 + 1) / F.col("total")
    count = lambda x: F.floor(F.col("target") * x + 0.5)
    near = both.withColumn("total", total).filter(F.col("total") > 0).withColumn("sure", count(low)).withColumn("most", count(high))
    seat = F.explode_outer(F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("most"))))
    ranked = near.withColumn("sure_all", F.sum("sure").over(w)).withColumn("j", seat)
    rank = F.row_number().over(w.orderBy((F.col("target") / (2 * F.col("j") - 1)).desc_nulls_last(), "place", "j"))
    won = F.col("j").isNotNull() & (rank <= F.col("house") - F.col("sure_all"))
    keys = [c for c in targeted.columns if c != "source"]
    return (
        ranked.withColumn("won", won.cast("long"))
        .groupBy("nth", "house", *keys)
        .agg(F.first("source").alias("source"), (F.first("sure") + F.sum("won")).cast("long").alias("seats"))
    )


def shard_quotas(targeted: DataFrame, blocks: int, n_shards: int) -> DataFrame:
    """Integer block quotas per output shard and source: shard, source, blocks (and columns of targeted).

    Shard s holds seats house(s-1) < n <= house(s); more seats never take one away from a source
    (house monotone), so quotas are differences of the seats of successive houses.
    """
    by_house = seats(targeted, [blocks * (s + 1) // n_shards for s in range(n_shards)])
    w = Window.partitionBy("place").orderBy("nth")
    return by_house.withColumn("shard", F.col("nth") + 1).withColumn("blocks", F.col("seats") - F.coalesce(F.lag("seats").over(w), F.lit(0)))


def block_plan(targeted: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[int, int]:
    """Tokens per block (fewer where the tables are small) and blocks (seats in all)."""
    tokens, n = targeted.agg(F.sum("source_size"), F.count("*")).first()
    block = max(1, min(block_tokens, (tokens or 0) // (max(1, n) * BLOCKS_PER_SOURCE)))
    return block, (tokens or 0) // block


def quotas(targeted: DataFrame, plan: tuple[int, int], max_repeats: int = MAX_REPEATS, n_shards: int = N_SHARDS) -> DataFrame:
    """Adds to each source: seats, block, blocks (its quota in each output shard, an array), shards (where each of
    them ends in the tokens of the source's passes, an array) and tokens (where the last ends)."""
    block, blocks = plan
    own = shard_quotas(targeted, blocks, n_shards).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("shard", "blocks"))).alias("by_shard"))  # n_shards rows each
    none = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda s: F.struct(s.alias("shard"), F.lit(0).cast("long").alias("blocks")))
    quota = F.transform(F.coalesce("by_shard", none), lambda x: x["blocks"].cast("long"))
    most = F.col("source_size") * max_repeats
    ends = F.transform("blocks", lambda _, i: F.least(F.aggregate(F.slice("blocks", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x) * block, most))
    return (
        targeted.join(own, "place", "left")
        .withColumn("blocks", quota)
        .withColumn("seats", F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("block", F.lit(block).cast("long"))
        .withColumn("shards", ends)
        .withColumn("tokens", F.element_at("shards", -1))
        .drop("by_shard")
    )


def mix(sized: DataFrame, key: str, quota: DataFrame, seed: int = 17, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds source_size, target, taken and parts (shard from 0, tokens: what goes to each output shard) to every document.

    Of every source all documents but one are taken a whole number of times, and `taken` rounded to whole
    documents misses the source's quota by no more than half of that one.
    """
    n_slices = quota.agg(F.greatest(F.lit(LEAST_SLICES), F.ceil(F.max("source_rows") / ROWS_PER_SLICE))).first()[0] or LEAST_SLICES
    mixed = F.xxhash64(F.lit(seed), F.col(key), F.col("size"))
    placed = sized.drop("source_size", "target", "taken", "parts").withColumn("h_", mixed).withColumn("slice_", F.pmod("h_", F.lit(n_slices)).cast("int"))
    per_slice = placed.groupBy("source", "slice_").agg(F.sum("size").alias("n_"))
    ahead = Window.partitionBy("source").orderBy("slice_")
    starts = per_slice.select(F.col("source").alias("s_"), F.col("slice_").alias("k_"), (F.sum("n_").over(ahead) - F.col("n_")).alias("at_"))
    inner = Window.partitionBy("source", "slice_").orderBy("h_", F.col(key), *ties).rowsBetween(Window.unboundedPreceding, 0)
    q = quota.select(F.col("source").alias("q_"), "source_size", "target", F.col("tokens").alias("tokens_"), F.col("shards").alias("shards_"))
    at = (
        placed.withColumn("ends_", F.sum("size").over(inner))
        .join(starts, F.col("source").eqNullSafe(F.col("s_")) & (F.col("slice_") == F.col("k_")))
        .join(q, F.col("source").eqNullSafe(F.col("q_")))
        .withColumn("at_", F.col("at_") + F.col("ends_") - F.col("size"))
    )
    zero = F.lit(0).cast("long")
    # in pass p the document is tokens at_ + p * source_size and on; the passes that the quota reaches
    passes = F.when((F.col("size") > 0) & (F.col("tokens_") > F.col("at_")), F.sequence(zero, F.floor((F.col("tokens_") - 1 - F.col("at_")) / F.col("source_size"))))

    def given(begin, end):
        within = lambda p: F.greatest(zero, F.least(F.col("at_") + p * F.col("source_size") + F.col("size"), end) - F.greatest(F.col("at_") + p * F.col("source_size"), begin))
        return F.aggregate(F.coalesce(passes, F.array().cast("array<long>")), zero, lambda a, p: a + within(p))

    shard = lambda end, i: F.struct(i.alias("shard"), given(F.when(i == 0, zero).otherwise(F.get("shards_", i - 1)), end).alias("tokens"))
    parts = F.filter(F.transform("shards_", shard), lambda x: x["tokens"] > 0)
    taken = F.aggregate("parts", zero, lambda a, x: a + x["tokens"])
    return at.withColumn("parts", parts).withColumn("taken", taken).drop("h_", "slice_", "ends_", "s_", "k_", "at_", "q_", "tokens_", "shards_")
