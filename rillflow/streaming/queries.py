"""Auction and viewer queries over unbounded streams; each needs a watermark on `ts`.

Chained windows key the second one by the first one's end: window_time() lies just before it, so a tumbling
window of one slide holds exactly the results of one end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.plans import nexmark

from .keyed import stateful_flatmap, stateful_map, stateful_map2

currency = nexmark.currency
selection = nexmark.selection
local_items = nexmark.local_items


def _best(results: DataFrame, slide: str, order: list[str], rest: list[str]) -> DataFrame:
    best = F.max(F.struct(*order, *rest)).alias("b")
    grouped = results.groupBy(F.window("at", slide).alias("v")).agg(best)
    return grouped.select(F.col("v.end").alias("window_end"), *[F.col(f"b.{c}").alias(c) for c in [*order, *rest]])


def bid_counts(bids: DataFrame, duration: str, slide: str) -> DataFrame:
    grouped = bids.groupBy(F.window("ts", duration, slide).alias("w"), "auction").agg(F.count("*").alias("bid_count"))
    return grouped.select(F.window_time("w").alias("at"), F.col("w.end").alias("window_end"), "auction", "bid_count")


def hot_items(bids: DataFrame, duration: str, slide: str) -> DataFrame:
    return _best(bid_counts(bids, duration, slide), slide, ["bid_count", "auction"], [])


def bidder_maxima(bids: DataFrame, duration: str) -> DataFrame:
    first = F.min(F.struct((-F.col("price")).alias("neg"), "ts", "bid_id", "auction")).alias("b")
    grouped = bids.groupBy(F.window("ts", duration).alias("w"), "bidder").agg(first)
    return grouped.select(F.window_time("w").alias("at"), F.col("w.end").alias("window_end"), (-F.col("b.neg")).alias("price"), F.col("b.auction").alias("auction"), "bidder")


def highest_bid(bids: DataFrame, duration: str) -> DataFrame:
    return _best(bidder_maxima(bids, duration), duration, ["price", "auction"], ["bidder"])


def new_users(persons: DataFrame, auctions: DataFrame, period: str) -> DataFrame:
    """Interval join with the state bounded by both watermarks (persons: id, name, ts; auctions: seller, auction_ts);
    a person comes once per auction, which dropDuplicatesWithinWatermark cuts to once."""
    inside: Column = (F.col("seller") == F.col("id")) & (F.col("auction_ts") >= F.col("ts")) & (F.col("auction_ts") <= F.col("ts") + F.expr(f"INTERVAL '{period}'"))
    return persons.join(auctions, inside).select("id", "name", "ts").dropDuplicatesWithinWatermark(["id"])


def timestamped(df: DataFrame, at: str | Column, delay: str = "0 seconds", unit: str = "ms", name: str = "ts") -> DataFrame:
    """Adds the event time, a column of whole numbers since the epoch (unit s, ms, us or ns) or of timestamps, and a
    watermark that lags by `delay` behind the largest one seen."""
    at = F.col(at) if isinstance(at, str) else at
    made = {"s": F.timestamp_seconds(at), "ms": F.timestamp_millis(at), "us": F.timestamp_micros(at), "ns": F.timestamp_micros(F.floor(at / 1000)), "timestamp": at.cast("timestamp")}[unit]
    return df.withColumn(name, made).withWatermark(name, delay)


def table(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{folder}/{name}.parque[t]")  # a pattern may match a file or a folder


def category_average(closed: DataFrame) -> DataFrame:
    """Per closed auction (id, category, final_price, closed_ms) its category's average so far."""

    def step(state, r):
        total, n = state or (0, 0)
        total, n = total + int(r.final_price), n + 1
        return (total, n), (int(r.id), r.category, total / n)

    kind = closed.schema["category"].dataType.simpleString()
    return stateful_map(closed, "category", ["closed_ms", "id"], step, f"id long, category {kind}, avg_price double")


def seller_average(closed: DataFrame, size: int = 10) -> DataFrame:
    """Per closed auction the average of its seller's last `size` prices."""

    def step(state, r):
        state = [*(state or []), int(r.final_price)][-size:]
        return state, (int(r.id), int(r.seller), sum(state) / len(state))

    return stateful_map(closed, "seller", ["closed_ms", "id"], step, "id long, seller long, avg_price double")


def route_median(trips: DataFrame, size: int = 20, value: str = "trip_time_secs") -> DataFrame:
    """Per trip (route: route and vendor) the lower median of the route's last `size` trips."""

    def step(state, r):
        state = [*(state or []), int(getattr(r, value))][-size:]
        return state, (int(r.trip_order), int(r.trip_line), r.route, sorted(state, reverse=True)[len(state) // 2], len(state))

    return stateful_map(trips, "route", ["dropoff_ts", "trip_order", "trip_line"], step, "trip_order long, trip_line long, route string, median long, n long")


def recent_medians(readings: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """Per reading (event_id, ts) the upper medians of the key's last `size` readings, for each column."""

    def step(state, r):
        state = [*(state or []), tuple(float(getattr(r, c)) for c in columns)][-size:]
        medians = [round(sorted(x)[len(x) // 2], 6) for x in zip(*state, strict=True)]
        return state, (int(r.event_id), getattr(r, key), *medians, len(state))

    kind = readings.schema[key].dataType.simpleString()
    return stateful_map(readings, key, ["ts", "event_id"], step, f"event_id long, {key} {kind}, {', '.join(f'med_{c} double' for c in columns)}, n long")


def retention(events: DataFrame) -> DataFrame:
    """Running retention score per streamer, from the second event on."""

    def step(state, r):
        viewers, n, ratios, last, score = state or (0, 0, 0.0, None, 0.0)
        viewers, n = viewers + (1 if r.entered else -1), n + 1
        ratios += viewers / n
        if last is None:
            return (viewers, n, ratios, int(r.secs), score), []
        dt = int(r.secs) - last
        score += ratios / n * dt
        return (viewers, n, ratios, int(r.secs), score), [(int(r.streamer_id), int(r.event_id), r.ts, dt, score)]

    return stateful_flatmap(events, "streamer_id", ["ts", "event_id"], step, "streamer_id long, event_id long, ts timestamp, dt long, score double")


def loyalty(retained: DataFrame) -> DataFrame:
    """Loyalty of each retention result: engagement is one state, time and number the other."""

    def step(engagement, watched, r):
        engagement = (engagement or 0.0) + r.score
        watch, k = watched or (0, 0)
        watch, k = watch + int(r.dt), k + 1
        return engagement, (watch, k), (int(r.streamer_id), int(r.event_id), r.ts, (engagement * 0.4 + watch * 0.3 + k * 0.3) / 100)

    return stateful_map2(retained, "streamer_id", ["ts", "event_id"], step, "streamer_id long, event_id long, ts timestamp, loyalty double")


def trend(loyal: DataFrame) -> DataFrame:
    """Running means of loyalty and of its smoothed trend per streamer."""

    def step(state, r):
        last, smooth, loyalties, trends, n = state or (0.0, 0.0, 0.0, 0.0, 0)
        smooth = 0.7 * smooth + 0.3 * (r.loyalty - last)
        loyalties, trends, n = loyalties + r.loyalty, trends + smooth, n + 1
        return (r.loyalty, smooth, loyalties, trends, n), (int(r.streamer_id), int(r.event_id), loyalties / n, trends / n, n)

    return stateful_map(loyal, "streamer_id", ["ts", "event_id"], step, "streamer_id long, event_id long, avg_loyalty double, avg_trend double, n long")
