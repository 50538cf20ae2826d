"""Queries over taxi trips, viewer activity and cluster telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions import expressions as E
from rillflow.operators import running, stateless, windows
from rillflow.sources import tables as S

PAD = "0Round0"


def routed(trips: DataFrame) -> DataFrame:
    """Trips with both ends on the grid, with their cells and route."""
    cells = trips.withColumn("start_cell", E.cell_id(F.col("pickup_longitude"), F.col("pickup_latitude"))).withColumn("end_cell", E.cell_id(F.col("dropoff_longitude"), F.col("dropoff_latitude")))
    on_grid = stateless.keep(cells, F.col("start_cell").isNotNull() & F.col("end_cell").isNotNull())
    return on_grid.withColumn("route_id", E.route_id(F.col("start_cell"), F.col("end_cell")))


def route_median(trips: DataFrame, n: int = 20, value: str = "trip_time_secs") -> DataFrame:
    """Per trip the median of its route's and vendor's last n trips; of an even number the lower one. Routes are few:
    sliced by month."""
    frame = {"held": F.collect_list(value)}
    out = running.last_n(routed(trips), ["route_id", "vendor"], ["dropoff_ts", "trip_order", "trip_line"], n, frame, F.trunc("dropoff_ts", "month"))
    return out.select("trip_order", "trip_line", F.col("route_id").cast("string").alias("route"), "vendor", running.lower_median(F.col("held")).alias("median"), F.size("held").cast("long").alias("n"))


def top_routes(trips: DataFrame, k: int = 10, duration: str = "28 days") -> DataFrame:
    """The k most frequent routes of each window, padded to k."""
    counts = windows.tumbling(routed(trips), "dropoff_ts", ["route_id"], duration, {"freq": F.count("*")})
    best = windows.top_k(counts, ["window_end"], [F.col("freq").desc(), F.col("route_id").desc()], k)
    row = F.struct("rank", F.col("route_id").cast("string").alias("route"), "freq")
    held = best.groupBy("window_end").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # k rows a window
    pad = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda r: F.coalesce(F.get("rows", r - 1), F.struct(r.alias("rank"), F.lit(PAD).alias("route"), F.lit(0).cast("long").alias("freq"))))
    return held.select("window_end", F.explode(pad).alias("x")).select("window_end", "x.rank", "x.route", "x.freq")


def recent_medians(readings: DataFrame, keys: list[str], columns: list[str], n: int, wide: bool = False) -> DataFrame:
    """Per reading the upper medians of the key's last n readings and their number; wide adds mean and maximum."""
    frame = {f"held_{c}": F.collect_list(c) for c in columns}
    if wide:
        frame |= {f"avg_{c}": F.avg(c) for c in columns} | {f"max_{c}": F.max(c) for c in columns}
    out = running.last_n(readings, keys, ["ts", "event_id"], n, frame)
    more = [F.round(f"{a}_{c}", 6).alias(f"{a}_{c}") for a in ("avg", "max") for c in columns] if wide else []
    medians = [F.round(running.upper_median(F.col(f"held_{c}")), 6).alias(f"med_{c}") for c in columns]
    return out.select("event_id", *keys, *medians, *more, F.size(f"held_{columns[0]}").cast("long").alias("n"))


def warmed(df: DataFrame, keys: list[str], ts: str, ids: list[str], n: int) -> DataFrame:
    """df with n older dummy rows before the first row of each key (`real` false): state filled ahead of time."""
    first = df.groupBy(*keys).agg(F.min(ts).alias("first_"))
    dummies = first.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k_"), "first_")
    older = (F.col("first_") - F.col("k_") * F.expr("INTERVAL '1' SECOND")).alias(ts)
    dummies = dummies.select(*keys, older, *[(-F.col("k_")).cast(df.schema[c].dataType).alias(c) for c in ids], F.lit(False).alias("real"))
    return df.withColumn("real", F.lit(True)).unionByName(dummies, allowMissingColumns=True)


def recent_medians_warm(readings: DataFrame, keys: list[str], columns: list[str], n: int) -> DataFrame:
    """recent_medians over filled state: dummies take places in the list and are left out of the statistics."""
    frame = {f"held_{c}": F.collect_list(F.when(F.col("real"), F.col(c))) for c in columns}
    out = running.last_n(warmed(readings, keys, "ts", ["event_id"], n), keys, ["ts", "event_id"], n, frame).filter("real")
    medians = [F.round(running.upper_median(F.col(f"held_{c}")), 6).alias(f"med_{c}") for c in columns]
    return out.select("event_id", *keys, *medians, F.size(f"held_{columns[0]}").cast("long").alias("n"))


def route_median_warm(trips: DataFrame, n: int = 20, value: str = "trip_time_secs") -> DataFrame:
    """route_median over filled state."""
    keys, ids = ["route_id", "vendor"], ["trip_order", "trip_line"]
    filled = warmed(routed(trips), keys, "dropoff_ts", ids, n)
    out = running.last_n(filled, keys, ["dropoff_ts", *ids], n, {"held": F.collect_list(F.when(F.col("real"), F.col(value)))}).filter("real")
    return out.select(*ids, F.col("route_id").cast("string").alias("route"), "vendor", running.lower_median(F.col("held")).alias("median"), F.size("held").cast("long").alias("n"))


def retention(events: DataFrame) -> DataFrame:
    """Running retention score per streamer, from the second event on."""
    keys, order = ["streamer_id", "streamer_name"], ["ts", "event_id"]
    w, at = running.so_far(keys, order), running.order_of(keys, order)
    seen = events.withColumn("viewers", F.sum(F.when(F.col("entered"), 1).otherwise(-1)).over(w)).withColumn("n_events", F.count("*").over(w))
    rated = seen.withColumn("avg_ratio", F.avg(F.col("viewers") / F.col("n_events")).over(w)).withColumn("dt", F.col("secs") - F.lag("secs").over(at))
    scored = rated.withColumn("score", F.sum(F.coalesce(F.col("avg_ratio") * F.col("dt"), F.lit(0.0))).over(w))
    return scored.filter("dt is not null").select(*keys, "event_id", "ts", "dt", "score")


def loyalty(events: DataFrame) -> DataFrame:
    w = running.so_far(["streamer_id", "streamer_name"], ["ts", "event_id"])  # the key that the rows are dealt by already
    held = retention(events).withColumn("engagement", F.sum("score").over(w)).withColumn("watch", F.sum("dt").over(w)).withColumn("k", F.count("*").over(w))
    return held.select("streamer_id", "streamer_name", "event_id", "ts", E.loyalty(F.col("engagement"), F.col("watch"), F.col("k")).alias("loyalty"))


def trend(events: DataFrame) -> DataFrame:
    """Running means of loyalty and of its smoothed trend per streamer."""
    keys, order = ["streamer_id", "streamer_name"], ["ts", "event_id"]
    steps = loyalty(events).withColumn("step", F.col("loyalty") - F.lag("loyalty", 1, 0.0).over(running.order_of(keys, order)))
    smooth = running.smoothed(steps, keys, order, "step", 0.7, "smooth")
    w = running.so_far(keys, order)
    return smooth.select("streamer_name", "event_id", F.avg("loyalty").over(w).alias("avg_loyalty"), F.avg("smooth").over(w).alias("avg_trend"), F.count("*").over(w).alias("n"))


def _single(df: DataFrame, *columns: str) -> DataFrame:
    """In single precision, which is the same whatever order an engine sums in."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


QUERIES = {
    "taxi_routes": lambda s, d: routed(S.trips(s, d)).select("trip_order", "trip_line", "start_cell", "end_cell", "route_id"),
    "taxi_route_median": lambda s, d: route_median(S.trips(s, d)),
    "taxi_route_median_warm": lambda s, d: route_median_warm(S.trips(s, d)),
    "taxi_passenger_median": lambda s, d: route_median(S.trips(s, d), value="passenger_count"),
    "taxi_top_routes": lambda s, d: top_routes(S.trips(s, d)),
    "azure_cpu_readings": lambda s, d: recent_medians(S.cpu_readings(s, d), ["vm_id"], ["min_cpu", "max_cpu", "avg_cpu"], 8),
    "azure_cpu_readings_warm": lambda s, d: recent_medians_warm(S.cpu_readings(s, d), ["vm_id"], ["min_cpu", "max_cpu", "avg_cpu"], 8),
    "borg_busy_machine_warm": lambda s, d: recent_medians_warm(S.task_events(s, d), ["job_id", "task_index"], ["cpu", "ram", "disk"], 10),
    "borg_busy_machine": lambda s, d: recent_medians(S.task_events(s, d), ["job_id", "task_index"], ["cpu", "ram", "disk"], 10),
    "borg_busy_machine_by_event": lambda s, d: recent_medians(S.task_events(s, d), ["job_id", "event_type"], ["cpu", "ram", "disk"], 4, wide=True),
    "twitch_retention": lambda s, d: _single(retention(S.viewer_events(s, d)), "score").drop("ts"),
    "twitch_loyalty": lambda s, d: _single(loyalty(S.viewer_events(s, d)), "loyalty").drop("ts"),
    "twitch_trend": lambda s, d: _single(trend(S.viewer_events(s, d)), "avg_loyalty", "avg_trend"),
}

_TRIPS = """SELECT l_orderkey AS trip_order, l_linenumber AS trip_line, l_returnflag AS vendor, l_shipdate AS dropoff_ts, l_quantity::BIGINT * 60 AS trip_time_secs,
    (l_linenumber % 6 + 1)::BIGINT AS passenger_count, floor((-74.95::DOUBLE + (l_suppkey % 10)::DOUBLE * 0.2::DOUBLE - (-74.913585)::DOUBLE) / 0.005986::DOUBLE) + 1 AS e1,
    floor((41.474937::DOUBLE - (41.45::DOUBLE - (l_partkey % 5)::DOUBLE * 0.3::DOUBLE)) / 0.004489::DOUBLE) + 1 AS s1,
    floor((-74.95::DOUBLE + (l_partkey % 7)::DOUBLE * 0.2::DOUBLE - (-74.913585)::DOUBLE) / 0.005986::DOUBLE) + 1 AS e2,
    floor((41.474937::DOUBLE - (41.45::DOUBLE - (l_suppkey % 3)::DOUBLE * 0.3::DOUBLE)) / 0.004489::DOUBLE) + 1 AS s2 FROM lineitem"""
_ROUTES = f"""SELECT *, start_cell * 90600 + end_cell AS route_id FROM (SELECT *, (s1 * 301 + e1)::BIGINT AS start_cell, (s2 * 301 + e2)::BIGINT AS end_cell FROM ({_TRIPS})
    WHERE e1 BETWEEN 1 AND 300 AND s1 BETWEEN 1 AND 300 AND e2 BETWEEN 1 AND 300 AND s2 BETWEEN 1 AND 300)"""
_MEDIAN = """SELECT trip_order, trip_line, route_id::VARCHAR AS route, vendor, list_sort(l, 'DESC')[len(l) // 2 + 1] AS median, len(l)::BIGINT AS n FROM (SELECT *,
    list({}) OVER (PARTITION BY route_id, vendor ORDER BY dropoff_ts, trip_order, trip_line ROWS 19 PRECEDING) AS l FROM ({}))"""
_TOP = f"""WITH c AS (SELECT time_bucket(INTERVAL 28 DAY, dropoff_ts, TIMESTAMP '1970-01-01') + INTERVAL 28 DAY AS window_end, route_id, count(*) AS freq FROM ({_ROUTES}) GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY freq DESC, route_id DESC) AS rank FROM c QUALIFY rank <= 10)
    SELECT w.window_end, r.rank::INTEGER AS rank, coalesce(t.route_id::VARCHAR, '0Round0') AS route, coalesce(t.freq, 0)::BIGINT AS freq
    FROM (SELECT DISTINCT window_end FROM c) w CROSS JOIN range(1, 11) r(rank) LEFT JOIN t ON t.window_end = w.window_end AND t.rank = r.rank"""


def _recent(source: str, keys: str, columns: list[str], n: int, wide: bool = False) -> str:
    frame = f"OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS {n - 1} PRECEDING)"
    lists = ", ".join(f"list({c}) {frame} AS l_{c}, round(avg({c}) {frame}, 6) AS avg_{c}, round(max({c}) {frame}, 6) AS max_{c}" for c in columns)
    medians = ", ".join(f"round(list_sort(l_{c})[len(l_{c}) // 2 + 1], 6) AS med_{c}" + (f", avg_{c}, max_{c}" if wide else "") for c in columns)
    return f"SELECT event_id, {keys}, {medians}, len(l_{columns[0]})::BIGINT AS n FROM (SELECT *, {lists} FROM ({source}))"


_CPU = "SELECT user_id AS vm_id, ts, event_id, value / 2 AS min_cpu, value AS max_cpu, value * 0.75::DOUBLE AS avg_cpu FROM events"
_TASKS = "SELECT user_id AS job_id, event_id % 4 AS task_index, event_type, ts, event_id, value AS cpu, value * 2 AS ram, value / 4 AS disk FROM events"
_RETENTION = """SELECT user_id AS streamer_id, 's' || user_id AS streamer_name, event_id, ts, dt, sum(coalesce(avg_ratio * dt, 0)) OVER w AS score FROM (
    SELECT *, avg(viewers / n_events) OVER w AS avg_ratio, secs - lag(secs) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt FROM (
        SELECT *, sum(CASE WHEN event_type IN ('signup', 'click', 'view') THEN 1 ELSE -1 END) OVER w AS viewers, count(*) OVER w AS n_events, epoch_us(ts) // 1000000 AS secs
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
_LOYALTY = f"""SELECT streamer_id, streamer_name, event_id, ts, (sum(score) OVER w * 0.4::DOUBLE + sum(dt) OVER w * 0.3::DOUBLE + count(*) OVER w * 0.3::DOUBLE) / 100 AS loyalty
    FROM (SELECT * FROM ({_RETENTION}) WHERE dt IS NOT NULL) WINDOW w AS (PARTITION BY streamer_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
_TREND = f"""SELECT streamer_name, event_id, (avg(loyalty) OVER w)::FLOAT::DOUBLE AS avg_loyalty, (avg(smooth) OVER w)::FLOAT::DOUBLE AS avg_trend, count(*) OVER w AS n FROM (
    SELECT *, list_reduce(list_prepend(0.0::DOUBLE, list(step) OVER w), lambda s, x: s * 0.7::DOUBLE + x * 0.3::DOUBLE) AS smooth FROM (
        SELECT *, loyalty - coalesce(lag(loyalty) OVER (PARTITION BY streamer_name ORDER BY ts, event_id), 0) AS step FROM ({_LOYALTY}))
    WINDOW w AS (PARTITION BY streamer_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    WINDOW w AS (PARTITION BY streamer_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""

ORACLES = {
    "taxi_routes": f"SELECT trip_order, trip_line, start_cell, end_cell, route_id FROM ({_ROUTES})",
    "taxi_route_median": _MEDIAN.format("trip_time_secs", _ROUTES),
    "taxi_passenger_median": _MEDIAN.format("passenger_count", _ROUTES),
    "taxi_top_routes": _TOP,
    "azure_cpu_readings": _recent(_CPU, "vm_id", ["min_cpu", "max_cpu", "avg_cpu"], 8),
    "borg_busy_machine": _recent(_TASKS, "job_id, task_index", ["cpu", "ram", "disk"], 10),
    "borg_busy_machine_by_event": _recent(_TASKS, "job_id, event_type", ["cpu", "ram", "disk"], 4, wide=True),
    "twitch_retention": f"SELECT streamer_id, streamer_name, event_id, dt, score::FLOAT::DOUBLE AS score FROM ({_RETENTION}) WHERE dt IS NOT NULL",
    "twitch_loyalty": f"SELECT streamer_id, streamer_name, event_id, loyalty::FLOAT::DOUBLE AS loyalty FROM ({_LOYALTY})",
    "twitch_trend": _TREND,
}
#: Filling state ahead of time changes no result.
ORACLES |= {f"{name}_warm": ORACLES[name] for name in ("taxi_route_median", "azure_cpu_readings", "borg_busy_machine")}
