"""A deterministic auction event generator: persons, auctions and bids as 1 : 3 : 46, with hot keys.

Events are numbered; every column is an expression of the number, so any range of events can be made by
any number of tasks (or by the rate source) with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the workload: proportions of event kinds, first ids.
PERSONS, AUCTIONS, BIDS = 1, 3, 46
FIRST_ID, FIRST_CATEGORY, CATEGORIES = 1000, 10, 5
STATES = ["AZ", "CA", "ID", "OR", "WA", "WY"]
CITIES = ["Phoenix", "Los Angeles", "San Francisco", "Boise", "Portland", "Bend", "Redmond", "Seattle", "Kent", "Cheyenne"]


@dataclass(frozen=True)
class Workload:
    """hot_*: one in how many does not go to the hot keys; *_gap: micros between events; in_flight: auctions that take bids."""

    hot_auction: int = 2
    hot_bidder: int = 4
    hot_seller: int = 4
    in_flight: int = 100
    active_people: int = 1000
    gap_us: int = 100
    seed: int = 50


def _draw(n: Column, salt: int, below: Column | int) -> Column:
    return F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(below) if isinstance(below, int) else below)


def events(numbers: DataFrame, w: Workload = Workload()) -> DataFrame:  # noqa: B008
    """numbers: a column `id`; adds kind, epoch, date_time (micros) and the counts of persons and auctions so far."""
    all_ = PERSONS + AUCTIONS + BIDS
    n, at = F.col("id"), F.pmod("id", F.lit(all_))
    kind = F.when(at < PERSONS, "person").when(at < PERSONS + AUCTIONS, "auction").otherwise("bid")
    epoch = F.floor(n / all_)
    people = epoch * PERSONS + F.least(at + 1, F.lit(PERSONS))
    lots = epoch * AUCTIONS + F.least(F.greatest(at - PERSONS + 1, F.lit(0)), F.lit(AUCTIONS))
    return numbers.select(n.alias("n"), kind.alias("kind"), (n * w.gap_us).alias("date_time"), people.alias("people"), lots.alias("lots"))


def persons(numbers: DataFrame, w: Workload = Workload()) -> DataFrame:  # noqa: B008
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (_draw(F.col("n"), w.seed + salt, len(values)) + 1).cast("int"))
    e = events(numbers, w).filter("kind = 'person'")
    card = F.lpad(_draw(F.col("n"), w.seed + 3, 10**12).cast("string"), 16, "4")
    return e.select(
        (F.col("people") - 1 + FIRST_ID).alias("id"), F.concat(F.lit("person"), F.col("people").cast("string")).alias("name"), F.concat(F.lit("p"), F.col("people").cast("string"), F.lit("@example.com")).alias("email"),
        card.alias("credit_card"), pick(CITIES, 1).alias("city"), pick(STATES, 2).alias("state"), "date_time", F.lit("").alias("extra"),
    )


def _someone(w: Workload, hot: int, salt: int) -> Column:
    """An active person: the newest multiple of the hot stride most times."""
    latest = F.col("people") - 1
    stride = 100
    back = F.least(latest + 1, F.lit(w.active_people))
    cold = latest - _draw(F.col("n"), w.seed + salt, back)
    return FIRST_ID + F.when(_draw(F.col("n"), w.seed + salt + 1, hot) > 0, F.floor(latest / stride) * stride).otherwise(cold)


def auctions(numbers: DataFrame, w: Workload = Workload()) -> DataFrame:  # noqa: B008
    e = events(numbers, w).filter("kind = 'auction'")
    first = _draw(F.col("n"), w.seed + 11, 10_000) + 1
    life = (_draw(F.col("n"), w.seed + 12, 2 * w.in_flight * (PERSONS + AUCTIONS + BIDS) // AUCTIONS) + 1) * w.gap_us
    name = F.concat(F.lit("item"), F.col("lots").cast("string"))
    return e.select(
        (F.col("lots") - 1 + FIRST_ID).alias("id"), name.alias("item_name"), F.lit("").alias("description"), first.alias("initial_bid"), (first * 2).alias("reserve"), "date_time",
        (F.col("date_time") + life).alias("expires"), _someone(w, w.hot_seller, 13).alias("seller"), (FIRST_CATEGORY + _draw(F.col("n"), w.seed + 15, CATEGORIES)).alias("category"), F.lit("").alias("extra"),
    )


def bids(numbers: DataFrame, w: Workload = Workload()) -> DataFrame:  # noqa: B008
    e = events(numbers, w).filter("kind = 'bid'")
    latest = F.col("lots") - 1
    cold = latest - _draw(F.col("n"), w.seed + 21, F.least(latest + 1, F.lit(w.in_flight)))
    auction = FIRST_ID + F.when(_draw(F.col("n"), w.seed + 22, w.hot_auction) > 0, F.floor(latest / 100) * 100).otherwise(cold)
    return e.select(auction.alias("auction"), _someone(w, w.hot_bidder, 23).alias("bidder"), (_draw(F.col("n"), w.seed + 25, 100_000) + 100).alias("price"), "date_time", F.lit("").alias("extra"))


def closed_auctions(numbers: DataFrame, w: Workload = Workload()) -> DataFrame:  # noqa: B008
    a = auctions(numbers, w)
    return a.select("id", F.col("seller").alias("seller_id"), (F.col("initial_bid") * 3).alias("final_price"), "category", F.col("expires").alias("date_time"), "extra")


def numbers(spark: SparkSession, n: int, tasks: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, tasks) if tasks else spark.range(n)


def numbers_stream(spark: SparkSession, per_second: int, tasks: int = 8) -> DataFrame:
    """Endless event numbers at a steady rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).option("numPartitions", tasks).load().select(F.col("value").alias("id"))
