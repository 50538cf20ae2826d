"""Streaming twins over file streams driven to their end; results equal the batch forms."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators import stateless, windows
from rillflow.plans import nexmark
from rillflow.sources import connectors, generated
from rillflow.sources import nexmark as gen
from rillflow import cli
from rillflow.plans import traces
from rillflow.sources import tables as S
from rillflow.streaming import catalog as streams
from rillflow.streaming import jobs, keyed, metrics, processors, queries, sinks

DIR = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def rocks(spark):
    processors.enable(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream(spark, df, path):
    df.coalesce(1).write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(k, ms) for ms in range(0, 2000, 100) for k in range(3)] + [(99, 10_000)]
    df = spark.createDataFrame(rows, "k long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    s = stream(spark, df, tmp_path / "in").withWatermark("ts", "0 seconds")
    out = windows.tumbling(s, "ts", ["k"], "500 milliseconds", {"n": F.count("*")})
    got = sinks.replayed(out, "tumbled", str(tmp_path / "cp")).collect()
    assert len(got) == 12 and all(r.n == 5 for r in got)
    slid = windows.sliding_stream(s, "ts", ["k"], "500 milliseconds", "100 milliseconds", {"n": F.count("*")})
    got = {(r.window_end, r.k): r.n for r in sinks.replayed(slid, "slid", str(tmp_path / "cp2")).collect()}
    batch = windows.sliding(df, "ts", ["k"], 5, "100 milliseconds", {"c": F.count("*")}, {"n": F.sum("c")}).filter("k < 99").collect()
    assert got == {(r.window_end, r.k): r.n for r in batch}


def test_stream_join(spark, tmp_path):
    people = spark.createDataFrame([(1, "a", "x", "OR"), (2, "b", "x", "WA")], "id long, name string, city string, state string")
    lots = spark.createDataFrame([(10, 1, 10), (11, 2, 10), (12, 1, 9), (13, 1, 10)], "id long, seller long, category long")
    pick = (F.col("state") == "OR", F.col("category") == 10)
    out = nexmark.local_items(stream(spark, people, tmp_path / "p"), stream(spark, lots, tmp_path / "a"), *pick)
    got = sinks.replayed(out, "joined", str(tmp_path / "cp")).collect()
    assert sorted(r.auction for r in got) == [10, 13]


def test_local_items_wait_for_their_person(spark, tmp_path):
    rows = [(1, "auction", None, None, None, 10), (1, "person", "a", "x", "OR", None), (1, "auction", None, None, None, 11), (2, "auction", None, None, None, 12)]
    df = spark.createDataFrame(rows, "id long, input string, name string, city string, state string, auction long")
    out = processors.keyed(stream(spark, df, tmp_path / "in"), "id", processors.LocalItems(), processors.LocalItems.schema)
    assert sorted(r.auction for r in sinks.replayed(out, "local", str(tmp_path / "cp")).collect()) == [10, 11]


def timed(spark, rows, schema, path):
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ts_ms"))
    return stream(spark, df, path).withWatermark("ts", "0 seconds")


def test_auctions_close_by_timer(spark, tmp_path):
    schema = "id long, input string, ts_ms long, price long, seller long, category long, expires_ms long"
    lots = [(1000, "auction", 100, None, 102, 5, 300), (1001, "auction", 500, None, 102, 5, 600), (9, "auction", 100_000, None, 1, 1, 200_000)]
    bids = [(1000, "bid", t, p, None, None, None) for p, t in [(40, 110), (60, 115), (90, 200), (150, 260), (450, 1000)]]
    fill = lambda rows: [tuple(0 if v is None else v for v in r) for r in rows]
    out = processors.keyed(timed(spark, fill(lots + bids), schema, tmp_path / "in"), "id", processors.ClosedAuctions(), processors.ClosedAuctions.schema, timers=True)
    got = sinks.replayed(out, "closed", str(tmp_path / "cp")).collect()
    assert [tuple(r) for r in got] == [(1000, 102, 5, 150, 300)]


def test_new_users_by_timer(spark, tmp_path):
    rows = [(100, "person", 0, "Alice"), (101, "person", 100, "Bob"), (102, "person", 200, "Cate"), (103, "person", 360, "Dave"), (1, "person", 3_600_000, "END")]
    rows += [(s, "auction", t, "") for s, t in [(102, 50), (100, 250), (100, 500), (101, 550), (102, 700), (100, 900)]]
    rows = [(i, side, t + 1000, n) for i, side, t, n in rows]  # a watermark begins at 0 and drops what isn't later
    out = processors.keyed(timed(spark, rows, "id long, input string, ts_ms long, name string", tmp_path / "in"), "id", processors.NewUsers(500), processors.NewUsers.schema, timers=True)
    assert sorted(r.name for r in sinks.replayed(out, "users", str(tmp_path / "cp")).collect()) == ["Alice", "Bob", "Cate"]


def test_period_sums_by_timer(spark, tmp_path):
    rows = [(k, side, t, 1) for k in (1, 2) for side in ("first", "second") for t in range(1000, 1400, 50)] + [(3, "first", 10_000, 1)]
    out = processors.keyed(timed(spark, rows, "key long, input string, ts_ms long, value long", tmp_path / "in"), "key", processors.PeriodSums(200), processors.PeriodSums.schema, timers=True)
    assert sorted(map(tuple, sinks.replayed(out, "periods", str(tmp_path / "cp")).collect())) == [(k, e, 4, 4) for k in (1, 2) for e in (1200, 1400)]


def test_changes_and_medians(spark, tmp_path):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 1, 2, 2, 2, 3, 1])], "key long, seq long, value long")
    out = processors.keyed(stream(spark, df, tmp_path / "a"), "key", processors.Changes(), processors.Changes.schema)
    got = sorted(map(tuple, sinks.replayed(out, "changes", str(tmp_path / "cpa")).collect()), key=lambda r: r[1])
    assert [r[3] for r in got] == [1, 0, 1, 0, 0, 1, 1] and [r[2] for r in got] == list(range(1, 8))
    df = spark.createDataFrame([("vm1", 100, 0.1), ("vm1", 350, 0.05), ("vm1", 1000, 0.15)], "key string, ts_ms long, value double")
    warm = spark.createDataFrame([("vm1", -1, 9.0)], "key string, ts_ms long, value double").groupBy("key")
    out = processors.keyed(stream(spark, df, tmp_path / "b"), "key", processors.RecentMedian(4), processors.RecentMedian.schema, initial=warm)
    got = sorted(map(tuple, sinks.replayed(out, "medians", str(tmp_path / "cpb")).collect()), key=lambda r: r[1])
    assert got == [("vm1", 100, 0.1, 1), ("vm1", 350, 0.1, 2), ("vm1", 1000, 0.1, 3)]


def test_jobs_deploy_rescale_and_report(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 5 AS k").write.parquet(str(tmp_path / "in"))
    js = jobs.Jobs(spark, str(tmp_path / "cp"))
    js.register("copy", lambda s: s.readStream.schema("id long, k long").parquet(str(tmp_path / "in")).filter("k < 3"))
    with pytest.raises(KeyError):
        js.deploy("other")
    with pytest.raises(ValueError):
        js.register("copy", lambda s: None)
    start = lambda df, cp: sinks.files(df, str(tmp_path / "out"), cp, availableNow=True)
    js.deploy("copy", start).awaitTermination()
    spark.range(50, 60).selectExpr("id", "id % 5 AS k").write.mode("append").parquet(str(tmp_path / "in"))
    query = js.rescale("copy", 4, start)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 36
    rows = metrics.table(spark, query)
    assert rows.filter("metric_type = 'input_rows'").agg(F.sum("metric_value")).first()[0] == 10


def test_generator_proportions_and_skew(spark):
    n = gen.numbers(spark, 50_000)
    assert (gen.persons(n).count(), gen.auctions(n).count(), gen.bids(n).count()) == (1000, 3000, 46_000)
    bids = gen.bids(n)
    assert bids.filter("auction < 1000 or bidder < 1000").count() == 0
    hot = bids.filter("(auction - 1000) % 100 = 0").count() / 46_000
    assert 0.45 < hot < 0.56
    assert bids.select(F.sum(F.hash("auction", "bidder", "price").cast("long"))).first() == gen.bids(gen.numbers(spark, 50_000, 3)).select(F.sum(F.hash("auction", "bidder", "price").cast("long"))).first()
    assert gen.auctions(n).filter("expires <= date_time or seller < 1000").count() == 0


def test_user_source_in_batch_and_stream(spark, tmp_path):
    generated.register(spark, "twos", "task int, v long", lambda task, start, end: ((task, 2 * i) for i in range(start, end)), 3, 10, 4, str(tmp_path / "progress"))
    assert spark.read.format("twos").load().count() == 30
    out = stateless.mapper(spark.readStream.format("twos").load(), w=F.col("v") + 1)
    for run in range(2):  # the second goes on from the checkpoint
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        tasks = max([0, *(p["numInputRows"] for p in query.recentProgress)])
        query.stop()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted((r.task, r.v) for r in got) == [(t, 2 * i) for t in range(3) for i in range(10)]
        assert run or tasks == 12  # per_batch offsets of each task


def test_trace_files(spark, tmp_path):
    (tmp_path / "borg.csv").write_text("5,,1,0,,1,u,0,0,0.5,,0.1,\n7,x,2,1,3,0,u,0,0,,0.2,0.1,true\n")
    got = connectors.borg_tasks(spark, str(tmp_path / "borg.csv")).orderBy("timestamp").collect()
    assert (got[0].machine_id, got[0].ram_request, got[0].constraint) == (-1, 0.0, False) and got[1].cpu_request == 0.0
    (tmp_path / "azure.csv").write_text("1,vm1,0.1,0.5,0.3\n3,vm1,0.2,0.6,0.4\n")
    (tmp_path / "bad.csv").write_text("1,vm1,0.1,0.5,0.3\nbad line\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        connectors.azure_readings(spark, str(tmp_path / "bad.csv")).collect()
    readings = connectors.azure_readings(spark, str(tmp_path / "azure.csv"))
    looped = connectors.looped(readings, "timestamp", 3).orderBy("timestamp").collect()
    assert [r.timestamp for r in looped] == [1, 3, 4, 6, 7, 9]
    (tmp_path / "twitch.csv").write_text("user_id,streamer_id,streamer_name,event_time,event_type\nu,1,a,5,ENTER\nu,1,a,zz,LEAVE\n")
    assert connectors.twitch_events(spark, str(tmp_path / "twitch.csv")).count() == 1


def test_stepped_rate(spark):
    got = spark.range(14).select(connectors.stepped("id", [(2, 2), (5, 1)]).alias("ms")).collect()
    assert [r.ms for r in got] == [0, 0, 200, 200, 400, 400, 400, 400, 400, 600, 600, 600, 600, 600]


def test_kafka_options():
    o = connectors.kafka_options("h:1", "t", 5)
    assert o["startingOffsets"] == "earliest" and o["maxOffsetsPerTrigger"] == "5" and o["subscribe"] == "t"


def test_chained_windows(spark, tmp_path):
    data = [(1, 10450), (1, 10600), (1, 10750), (2, 10700), (2, 11000), (3, 12800), (3, 12820), (3, 12830), (3, 12900), (3, 14900), (9, 99_000)]
    df = spark.createDataFrame([(a, a, 10 * i, i, ms) for i, (a, ms) in enumerate(data)], "auction long, bidder long, price long, bid_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    bids = stream(spark, df, tmp_path / "in").withWatermark("ts", "0 seconds")
    got = sinks.replayed(queries.hot_items(bids, "1 second", "500 milliseconds"), "hot", str(tmp_path / "a")).select(F.unix_millis("window_end"), "auction", "bid_count").collect()
    want = {10500: (1, 1), 11000: (1, 3), 11500: (2, 2), 12000: (2, 1), 13000: (3, 4), 13500: (3, 4), 15000: (3, 1), 15500: (3, 1)}
    assert {r[0]: (r[1], r[2]) for r in got} == want
    got = sinks.replayed(queries.highest_bid(bids, "2 seconds"), "top", str(tmp_path / "b")).select(F.unix_millis("window_end"), "price", "auction").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {12000: (40, 2), 14000: (80, 3), 16000: (90, 3)}


def test_interval_join_emits_each_person_once(spark, tmp_path):
    people = spark.createDataFrame([(100, "Alice", 1000), (101, "Bob", 1100), (103, "Dave", 1360), (1, "END", 3_600_000)], "id long, name string, ms long").select("id", "name", F.timestamp_millis("ms").alias("ts"))
    lots = spark.createDataFrame([(100, 1250), (100, 1500), (101, 1600), (101, 1601), (100, 1900), (1, 3_600_000)], "seller long, ms long").select("seller", F.timestamp_millis("ms").alias("auction_ts"))
    p = stream(spark, people, tmp_path / "p").withWatermark("ts", "0 seconds")
    a = stream(spark, lots, tmp_path / "a").withWatermark("auction_ts", "0 seconds")
    got = sinks.replayed(queries.new_users(p, a, "500 milliseconds"), "once", str(tmp_path / "cp")).collect()
    assert sorted(r.name for r in got if r.name != "END") == ["Alice", "Bob"]


def test_event_time_and_watermark(spark, tmp_path):
    df = spark.createDataFrame([(1_500_000_000,)], "at long")
    got = [queries.timestamped(df, "at", unit=u).select(F.unix_micros("ts")).first()[0] for u in ("s", "ms", "us", "ns")]
    assert got == [1_500_000_000_000_000, 1_500_000_000_000, 1_500_000_000, 1_500_000]
    out = queries.timestamped(stream(spark, df, tmp_path / "in"), F.col("at") + 1, "7 seconds")
    assert "7 seconds" in out._jdf.queryExecution().analyzed().toString() and "EventTimeWatermark" in out._jdf.queryExecution().analyzed().toString()


def test_keyed_state_of_the_users_own(spark, tmp_path):
    df = stream(spark, spark.createDataFrame([(k, i, i % 3) for i in range(9) for k in ("a", "b")], "k string, at long, v long"), tmp_path / "in")
    run = lambda out, name: sorted(map(tuple, sinks.replayed(out, name, str(tmp_path / name)).collect()))
    counted = keyed.stateful_map(df, "k", ["at"], lambda s, r: ((s or 0) + 1, (r.k, int(r.at), (s or 0) + 1)), "k string, at long, n long")
    assert run(counted, "counted") == [(k, i, i + 1) for k in "ab" for i in range(9)]
    repeated = keyed.stateful_flatmap(df, "k", ["at"], lambda s, r: ((s or 0) + r.v, [(r.k, int(r.at))] * int(r.v)), "k string, at long")
    assert run(repeated, "repeated") == sorted((k, i) for k in "ab" for i in range(9) for _ in range(i % 3))
    two = keyed.stateful_map2(df, "k", ["at"], lambda a, b, r: ((a or 0) + 1, max(b or 0, r.v), (r.k, int(r.at), (a or 0) + 1, int(max(b or 0, r.v)))), "k string, at long, n long, most long")
    assert run(two, "two") == [(k, i, i + 1, min(i, 2)) for k in "ab" for i in range(9)]


def test_state_goes_on_from_the_checkpoint(spark, tmp_path):
    total = lambda s, r: ((s or 0) + int(r.v), (int(r.k), (s or 0) + int(r.v)))
    for part in range(3):
        spark.createDataFrame([(1, part, 10)], "k long, at long, v long").write.mode("append").parquet(str(tmp_path / "in"))
        df = spark.readStream.schema("k long, at long, v long").parquet(str(tmp_path / "in"))
        sinks.files(keyed.stateful_map(df, "k", ["at"], total, "k long, total long"), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert sorted(r.total for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [10, 20, 30]


def test_late_rows_fire_a_window_again(spark, tmp_path):
    batches = [[(1, 100, 5), (1, 150, 6)], [(1, 1300, 1)], [(1, 120, 7)], [(1, 5200, 1)], [(1, 5300, 1)], [(1, 110, 100), (1, 9000, 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key long, ts_ms long, value long").coalesce(1).write.parquet(str(tmp_path / "src" / f"b={i}"))
    s = spark.readStream.schema("key long, ts_ms long, value long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "src"))
    s = queries.timestamped(s, "ts_ms", "2 seconds")
    out = processors.keyed(s, "key", processors.RefiringWindows(1000, 2000), processors.RefiringWindows.schema, timers=True)
    got = sorted(map(tuple, sinks.replayed(out, "refired", str(tmp_path / "cp")).collect()), key=lambda r: (r[1], r[4]))
    first = [r for r in got if r[1] == 1000]
    assert first[-1][2:4] == (18, 3) and [r[4] for r in first] == list(range(1, len(first) + 1))  # 100 came after the lateness and is dropped
    assert {r[1] for r in got} >= {1000, 2000}


def test_auction_averages_on_streams(spark, tmp_path):
    closed = S.closed_auctions(spark, DIR).withColumn("closed_ms", F.unix_millis(F.col("ts").cast("timestamp"))).filter("id < 1500")
    s = stream(spark, closed, tmp_path / "in")
    plain = lambda df: sorted(map(tuple, df.collect()))
    near = lambda df: [(*r[:2], pytest.approx(r[2], abs=1e-4)) for r in plain(df)]  # noqa: E731  the batch form rounds to 4 digits
    got = sinks.replayed(queries.category_average(s), "averages", str(tmp_path / "a"))
    assert plain(got) == near(nexmark.category_average(closed, "ts").select("id", "category", "avg_price"))
    got = sinks.replayed(queries.seller_average(s), "sellers", str(tmp_path / "b"))
    assert plain(got) == near(nexmark.seller_average(closed, "ts").select("id", "seller", "avg_price"))


def test_closed_auctions_feed_averages(spark, tmp_path):
    schema = "id long, input string, ts_ms long, price long, seller long, category long, expires_ms long"
    rows = [(i, "auction", 1000 + i, 0, 7, 5, 1100 + 10 * i) for i in range(1, 5)] + [(i, "bid", 1050, 10 * i, 0, 0, 0) for i in range(1, 5)] + [(9, "auction", 100_000, 0, 1, 1, 200_000)]
    closed = processors.keyed(timed(spark, rows, schema, tmp_path / "in"), "id", processors.ClosedAuctions(), processors.ClosedAuctions.schema, timers=True)
    out = queries.category_average(closed)
    got = sorted(map(tuple, sinks.replayed(out, "chained", str(tmp_path / "cp")).collect()))
    assert got == [(1, 5, 10.0), (2, 5, 15.0), (3, 5, 20.0), (4, 5, 25.0)]


@pytest.mark.parametrize("name, batch", [("twitch", "twitch_trend"), ("azure", "azure_cpu_readings"), ("taxi", "taxi_route_median"), ("borg", "borg_busy_machine")])
def test_trace_jobs_on_streams(spark, tmp_path, name, batch):
    out = streams.build(spark, name, DIR)
    got = sinks.replayed(out, f"job_{name}", str(tmp_path / "cp"))
    want = traces.QUERIES[batch](spark, DIR)
    columns = [c for c in got.columns if c in want.columns and c not in ("route",)]
    assert len(columns) >= 3
    order = sorted(columns, key=lambda c: isinstance(got.schema[c].dataType, T.DoubleType))  # whole numbers first
    a, b = (sorted(tuple(r[c] for c in order) for r in df.collect()) for df in (got, want))
    assert len(a) > 500 and a == [tuple(pytest.approx(x, rel=1e-6, abs=1e-6) if isinstance(x, float) else x for x in r) for r in b]


def test_records_round_trip_as_json(spark):
    df = spark.createDataFrame([(1, "a", 0.1, None), (2, 'q"\né', 1e300, [1, 2])], "id long, s string, x double, l array<int>")
    records = connectors.encoded(df, "id")
    assert records.columns == ["key", "value"] and [r.key for r in records.orderBy("key").collect()] == ["1", "2"]
    assert sorted(map(tuple, connectors.decoded(records.withColumn("value", F.col("value").cast("binary")), df.schema).collect())) == sorted(map(tuple, df.collect()))
    queued = connectors.decoded(records.withColumn("timestamp", F.current_timestamp()), df.schema)
    assert queued.columns == [*df.columns, "queue_ms"] and all(0 <= r.queue_ms < 60_000 for r in queued.collect())


def test_deploy_and_rescale_from_a_shell(spark, tmp_path):
    (tmp_path / "t").mkdir()
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.filter("event_id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "t" / "events.parquet"))
    where = ["--out", str(tmp_path / "out"), "--checkpoints", str(tmp_path / "cp"), "--once"]
    cli.main(["deploy", "nexmark_query1", str(tmp_path / "t"), *where])
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == events.filter("event_id % 2 = 0").count()
    cli.main(["rescale", "nexmark_query1", str(tmp_path / "t"), "--tasks", "3", *where])
    assert spark.read.parquet(str(tmp_path / "out")).count() == n and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(SystemExit):
        cli.main(["deploy", "no such job", "x", *where])
