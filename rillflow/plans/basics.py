"""Small queries that show one operator each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators import joins, running, stateless, windows
from rillflow.operators.aggregate import Aggregator, aggregate
from rillflow.sources import tables as S


def counter(df: DataFrame, keys: list[str], order: list[str], slice_by) -> DataFrame:
    """Per row how many rows its key has had so far. Keys may be few: sliced."""
    return running.running_sums(df, keys, order, slice_by, {"n": F.lit(1).cast("long")})


def words(df: DataFrame) -> DataFrame:
    """conv_id, turn, place, word."""
    split = F.split(F.coalesce("text", F.lit("")), " ")
    return df.select("conv_id", "turn", F.posexplode(split).alias("place", "word")).filter("word <> ''")


def moving_average(df: DataFrame, keys: list[str], panes: int, slide: str) -> DataFrame:
    """Whole-number mean of each key's sliding windows."""
    out = windows.sliding(df, "ts", keys, panes, slide, {"s": F.sum("v"), "c": F.count("*")}, {"s": F.sum("s"), "c": F.sum("c")})
    return out.select("window_end", *keys, F.expr("s div c").alias("mean"))


#: The second largest of all values (the largest, if it is alone), which no built-in aggregate gives with partial merging.
SECOND = Aggregator(lambda: (), lambda s, r: tuple(sorted((*s, r.cents))[-2:]), lambda a, b: tuple(sorted((*a, *b))[-2:]), lambda s: s[0])


def _events(s, d: str, *kinds: str) -> DataFrame:
    e = S.load(s, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return e.filter(F.col("event_type").isin(*kinds)) if kinds else e


def _words(s, d: str) -> DataFrame:
    return words(S.load(s, d, "conversations"))


QUERIES = {
    "counter": lambda s, d: counter(_events(s, d), ["event_type"], ["ts", "event_id"], F.to_date("ts")).select("event_id", "event_type", "n"),
    "counter_composite_key": lambda s, d: counter(_events(s, d), ["user_id", "event_type"], ["ts", "event_id"], F.to_date("ts")).select("event_id", "user_id", "event_type", "n"),
    "filter_prefix": lambda s, d: stateless.keep(S.load(s, d, "nation"), ~F.substring("n_name", 1, 1).isin("A", "B")).select("n_nationkey", "n_name"),
    "mapper": lambda s, d: stateless.mapper(_events(s, d), cents=F.col("cents") + 1).select("event_id", "cents"),
    "flatmap_words": _words,
    "word_count": lambda s, d: _words(s, d).groupBy("word").agg(F.count("*").alias("n")),
    "word_count_running": lambda s, d: counter(_words(s, d), ["word"], ["conv_id", "turn", "place"], F.floor(F.col("conv_id") / 4096)).select("conv_id", "turn", "place", "word", "n"),
    "tumbling_count": lambda s, d: windows.tumbling(_events(s, d), "ts", ["event_type"], "6 hours", {"n": F.count("*")}),
    "sliding_count": lambda s, d: windows.sliding(_events(s, d), "ts", ["event_type"], 5, "1 hour", {"c": F.count("*")}, {"n": F.sum("c")}),
    "moving_average": lambda s, d: moving_average(_events(s, d).withColumn("v", F.col("cents")), ["user_id"], 5, "1 day"),
    "dedup_changes": lambda s, d: _events(s, d).select("event_id", "user_id", "event_type", running.changed("event_type", ["user_id"], ["ts", "event_id"]).alias("is_new")),
    "ledger_join": lambda s, d: joins.ledger(_events(s, d, "purchase"), _events(s, d, "error"), "user_id", "cents"),
    "period_join": lambda s, d: joins.period_sums(_events(s, d, "purchase"), _events(s, d, "click"), "user_id", "ts", "cents", "1 day"),
    "multi_source_count": lambda s, d: stateless.merge(_events(s, d, "view"), _events(s, d, "signup")).groupBy("user_id").agg(F.count("*").alias("n")),
    "custom_aggregate": lambda s, d: aggregate(_events(s, d).select("user_id", "cents"), ["user_id"], SECOND, T.StructField("second", T.LongType())),
    "top_events": lambda s, d: windows.top_k(_events(s, d).select("event_id", "user_id", "cents"), ["user_id"], [F.col("cents").desc(), F.col("event_id")], 3),
}

_E = "SELECT *, round(value * 100)::BIGINT AS cents FROM events"
_W = "SELECT conv_id, turn, (place - 1)::INTEGER AS place, word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS place FROM conversations) WHERE word <> ''"
_B = "time_bucket(INTERVAL {0}, ts, TIMESTAMP '1970-01-01')"

ORACLES = {
    "counter": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events",
    "counter_composite_key": "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events",
    "filter_prefix": "SELECT n_nationkey, n_name FROM nation WHERE n_name[1] NOT IN ('A', 'B')",
    "mapper": f"SELECT event_id, cents + 1 AS cents FROM ({_E})",
    "flatmap_words": _W,
    "word_count": f"SELECT word, count(*) AS n FROM ({_W}) GROUP BY word",
    "word_count_running": f"SELECT *, row_number() OVER (PARTITION BY word ORDER BY conv_id, turn, place) AS n FROM ({_W})",
    "tumbling_count": f"SELECT {_B.format('6 HOUR')} AS window_start, {_B.format('6 HOUR')} + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sliding_count": f"SELECT w AS window_start, w + INTERVAL 5 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT *, {_B.format('1 HOUR')} - k * INTERVAL 1 HOUR AS w FROM events, range(5) r(k)) GROUP BY ALL",
    "moving_average": f"SELECT w + INTERVAL 5 DAY AS window_end, user_id, (sum(cents)::BIGINT // count(*)) AS mean FROM (SELECT *, {_B.format('1 DAY')} - k * INTERVAL 1 DAY AS w FROM ({_E}), range(5) r(k)) GROUP BY w, user_id",
    "dedup_changes": "SELECT event_id, user_id, event_type, (CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END)::INTEGER AS is_new FROM events",
    "ledger_join": f"SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN cents ELSE -cents END)::BIGINT AS state1, sum(CASE event_type WHEN 'purchase' THEN -cents ELSE cents END)::BIGINT AS state2 FROM ({_E}) WHERE event_type IN ('purchase', 'error') GROUP BY user_id",
    "period_join": f"SELECT {_B.format('1 DAY')} + INTERVAL 1 DAY AS period_end, user_id, sum(CASE event_type WHEN 'purchase' THEN cents ELSE 0 END)::BIGINT AS sum1, sum(CASE event_type WHEN 'click' THEN cents ELSE 0 END)::BIGINT AS sum2 FROM ({_E}) WHERE event_type IN ('purchase', 'click') GROUP BY ALL",
    "multi_source_count": "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'signup') GROUP BY user_id",
    "custom_aggregate": f"SELECT user_id, list_sort(list(cents), 'DESC')[least(2, count(*))] AS second FROM ({_E}) GROUP BY user_id",
    "top_events": f"SELECT event_id, user_id, cents, (row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id))::INTEGER AS rank FROM ({_E}) QUALIFY rank <= 3",
}
