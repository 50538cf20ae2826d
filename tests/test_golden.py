"""Hand-made inputs with known results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillflow.operators import running, stateless, windows
from rillflow.plans import nexmark, traces

T0 = datetime(1970, 1, 1)


def at(us):
    return T0 + timedelta(microseconds=us)


def us(ts):
    return int((ts - T0) / timedelta(microseconds=1))


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_currency_cuts_towards_zero(spark):
    prices = [100, 500, 200, 800, 600, 300, 900, 700, 400, -7]
    got = nexmark.currency(frame(spark, [(p,) for p in prices], "price long")).collect()
    assert [r.price for r in got] == [85, 425, 170, 680, 510, 255, 765, 595, 340, -5]


def test_selection_keeps_whole_rows(spark):
    bids = [(1000, 1), (2000, 2), (1003, 3), (2001, 300), (1007, 500), (1566, 4), (1007, 900), (1087, 700), (2019, 400)]
    got = nexmark.selection(frame(spark, bids, "auction long, price long")).collect()
    assert sorted(map(tuple, got)) == [(1007, 500), (1007, 900), (1087, 700), (2001, 300), (2019, 400)]


def test_local_items(spark):
    people = frame(spark, [(100, "Alice", "BOS", "MA"), (101, "Bob", "BOS", "OR"), (102, "Cate", "BOS", "OR"), (103, "Dave", "BOS", "OR"), (110, "E", "BOS", "OR")], "id long, name string, city string, state string")
    lots = frame(spark, [(1000, 101, 15), (1000, 101, 10), (1001, 102, 10), (1002, 103, 10), (1003, 200, 10), (1004, 102, 10), (1005, 101, 10)], "id long, seller long, category long")
    got = nexmark.local_items(people, lots, F.col("state") == "OR", F.col("category") == 10).collect()
    assert sorted((r.name, r.auction) for r in got) == [("Bob", 1000), ("Bob", 1005), ("Cate", 1001), ("Cate", 1004), ("Dave", 1002)]
    inverted = nexmark.local_items(people, lots, F.col("state") != "OR", F.col("category") != 10).collect()
    assert inverted == []


def test_closed_auctions_take_bids_up_to_their_end(spark):
    lots = frame(spark, [(1000, 102, 5, at(300)), (1001, 102, 5, at(600)), (9000, 102, 5, at(1100000))], "id long, seller long, category long, expires timestamp_ntz")
    bids = frame(spark, [(1000, 40, at(110)), (1000, 60, at(115)), (1000, 90, at(200)), (1000, 150, at(260)), (1000, 450, at(1000)), (9000, 46532, at(10000))], "auction long, price long, bid_ts timestamp_ntz")
    got = nexmark.closed_auctions(lots, bids).collect()
    assert sorted((r.id, r.final_price) for r in got) == [(1000, 150), (9000, 46532)]


def test_category_average(spark):
    prices = [(1, 100), (2, 500), (1, 200), (3, 800), (2, 600), (1, 300), (3, 900), (2, 700), (1, 400)]
    src = frame(spark, [(i, c, p, at(i * 86_400_000_000 // 3)) for i, (c, p) in enumerate(prices)], "id long, category long, final_price long, ts timestamp_ntz")
    got = nexmark.category_average(src, "ts").orderBy("id").collect()
    assert [(r.category, r.avg_price) for r in got] == [(1, 100), (2, 500), (1, 150), (3, 800), (2, 550), (1, 200), (3, 850), (2, 600), (1, 250)]


def test_seller_average_slides_over_ten(spark):
    data = [(i, 101, 100 * (i + 1), at(i)) for i in range(11)] + [(20, 202, 500, at(1)), (21, 202, 600, at(2))]
    got = nexmark.seller_average(frame(spark, data, "id long, seller long, final_price long, ts timestamp_ntz"), "ts").orderBy("id").collect()
    assert [r.avg_price for r in got] == [100, 150, 200, 250, 300, 350, 400, 450, 500, 550, 650, 500, 550]


def test_hot_items(spark):
    data = [(1, 10450), (1, 10600), (1, 10750), (2, 10700), (2, 11000), (3, 12800), (3, 12820), (3, 12830), (3, 12900), (3, 14900)]
    bids = frame(spark, [(a, at(t)) for a, t in data], "auction long, ts timestamp_ntz")
    counts = {(us(r.window_end), r.auction): r.bid_count for r in nexmark.bid_counts(bids, 2, "500 microseconds").collect()}
    assert counts == {(10500, 1): 1, (11000, 1): 3, (11000, 2): 1, (11500, 1): 2, (11500, 2): 2, (12000, 2): 1, (13000, 3): 4, (13500, 3): 4, (15000, 3): 1, (15500, 3): 1}
    hot = {us(r.window_end): (r.auction, r.bid_count) for r in nexmark.hot_items(bids, 2, "500 microseconds").collect()}
    assert hot == {10500: (1, 1), 11000: (1, 3), 11500: (2, 2), 12000: (2, 1), 13000: (3, 4), 13500: (3, 4), 15000: (3, 1), 15500: (3, 1)}


def test_highest_bid(spark):
    data = [(1, 101, 500, 5), (2, 101, 600, 10), (3, 101, 550, 20), (4, 102, 300, 25), (5, 102, 700, 30), (6, 103, 200, 35), (10, 202, 900, 40), (7, 201, 400, 45), (8, 201, 700, 50), (9, 202, 650, 55), (11, 203, 1000, 75), (12, 203, 500, 70)]
    bids = frame(spark, [(a, b, p, at(t), i) for i, (a, b, p, t) in enumerate(data)], "auction long, bidder long, price long, ts timestamp_ntz, bid_id long")
    maxima = {(us(r.window_end), r.bidder): (r.price, r.auction) for r in nexmark.bidder_maxima(bids, "40 microseconds").collect()}
    assert maxima == {(40, 101): (600, 2), (40, 102): (700, 5), (40, 103): (200, 6), (80, 201): (700, 8), (80, 202): (900, 10), (80, 203): (1000, 11)}
    assert {us(r.window_end): (r.price, r.auction, r.bidder) for r in nexmark.highest_bid(bids, "40 microseconds").collect()} == {40: (700, 5, 102), 80: (1000, 11, 203)}


def test_new_users_with_both_ends_closed(spark):
    people = frame(spark, [(100, "Alice", at(0)), (101, "Bob", at(100)), (102, "Cate", at(200)), (103, "Dave", at(360)), (10002, "Emily", at(1800))], "id long, name string, ts timestamp_ntz")
    lots = frame(spark, [(s, at(t)) for s, t in [(102, 50), (100, 250), (100, 500), (101, 550), (102, 700), (100, 900), (102, 2000)]], "seller long, auction_ts timestamp_ntz")
    got = nexmark.new_users(people, lots, "500 microseconds").collect()
    assert sorted(r.name for r in got) == ["Alice", "Bob", "Cate"]


def test_recent_medians_are_upper(spark):
    data = [(100, "vm1", 0.1, 0.5, 0.3), (200, "vm2", 0.2, 0.6, 0.4), (350, "vm1", 0.05, 0.4, 0.25), (1000, "vm1", 0.15, 0.55, 0.35)]
    df = frame(spark, [(at(t), t, *r) for t, *r in data], "ts timestamp_ntz, event_id long, vm_id string, min_cpu double, max_cpu double, avg_cpu double")
    got = {r.event_id: tuple(r)[1:] for r in traces.recent_medians(df, ["vm_id"], ["min_cpu", "max_cpu", "avg_cpu"], 4).collect()}
    assert got == {100: ("vm1", 0.1, 0.5, 0.3, 1), 200: ("vm2", 0.2, 0.6, 0.4, 1), 350: ("vm1", 0.1, 0.5, 0.3, 2), 1000: ("vm1", 0.1, 0.5, 0.3, 3)}


def test_trend(spark):
    events = [("A", 1, 1000, True), ("A", 1, 2000, False), ("A", 1, 3000, True), ("A", 1, 4000, False), ("C", 5, 9000, True), ("C", 5, 10000, False)]
    df = frame(spark, [(i, n, at(t), t, e, t) for n, i, t, e in events], "streamer_id long, streamer_name string, ts timestamp_ntz, event_id long, entered boolean, secs long")
    got = [tuple(r)[2:] for r in traces.trend(df).orderBy("event_id").collect()]
    want = [(5.003, 1.5009, 1), (8.39338888888889, 2.2928816666666663, 2), (12.228222222222222, 3.059800333333333, 3), (5.003, 1.5009, 1)]
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w)


def test_smoothing_of_long_keys_equals_the_fold(spark):
    values = [((i * 7919) % 101) / 10 for i in range(1500)]
    df = frame(spark, [(1, i, v) for i, v in enumerate(values)], "k long, i long, v double")
    got = [r.s for r in running.smoothed(df, ["k"], ["i"], "v", 0.7, "s").orderBy("i").collect()]
    s = 0.0
    for g, v in zip(got, values, strict=True):
        s = s * 0.7 + v * 0.3
        assert g == pytest.approx(s, rel=1e-9)


def test_chunked_frames_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(running, "CHUNK", 7)
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 37 % 11).alias("v"))
    agg = {"m": F.max("v"), "n": F.count("*")}
    plain = running.last_n(df, ["k"], ["id"], 5, agg).orderBy("id").collect()
    cut = running.last_n(df, ["k"], ["id"], 5, agg, slice_by=F.floor(F.col("id") / 13)).orderBy("id").collect()
    assert [(r.id, r.m, r.n) for r in plain] == [(r.id, r.m, r.n) for r in cut]


def test_out_of_order_windows_count_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.timestamp_micros(F.floor(F.col("id") / 10) * 200_000 + (F.col("id") * 7919) % 100_000).alias("ts"))
    got = windows.tumbling(df, "ts", ["k"], "1 second", {"n": F.count("*")}).collect()
    assert len(got) == 200 and all(r.n == 5 for r in got)


def test_empty_and_null_inputs(spark):
    bids = frame(spark, [], "auction long, bidder long, price long, ts timestamp_ntz, bid_id long")
    assert nexmark.hot_items(bids).collect() == [] and nexmark.highest_bid(bids).collect() == []
    nulls = frame(spark, [(None, None, None, at(1), 1)], "auction long, bidder long, price long, ts timestamp_ntz, bid_id long")
    assert nexmark.currency(nulls).collect()[0].price is None and nexmark.selection(nulls).collect() == []


def test_exchanges(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").coalesce(1)
    sizes = [r[1] for r in stateless.round_robin(df, 4).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 8
    dealt = stateless.key_by(df, 4, "k").select("k", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(dealt) == 7  # all rows of a key in one task
    text = stateless.key_by(df, 4, "k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1  # what follows by the same key isn't shuffled again
    buckets = spark.range(20_000).select(stateless.key_bucket("id").alias("b")).groupBy("b").count().collect()
    assert {r.b for r in buckets} == set(range(128)) and max(r["count"] for r in buckets) < 2 * min(r["count"] for r in buckets)
    assert spark.range(5).select(stateless.key_bucket("id", buckets=1)).distinct().count() == 1


def test_flatmap_and_merge(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id long, items array<long>")
    assert [(r.id, r.item) for r in stateless.flatmap(df, F.col("items"), "item").collect()] == [(1, 1), (1, 2)]
    merged = stateless.tagged([("a", spark.createDataFrame([(1,)], "x long")), ("b", spark.createDataFrame([(2, "s")], "x long, y string"))])
    assert sorted((r.input, r.x, r.y) for r in merged.collect()) == [("a", 1, None), ("b", 2, "s")]
