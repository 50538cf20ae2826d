"""Auction queries. Each is a function of streams; `QUERIES` binds them to the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import expressions as E
from rillflow.operators import joins, running, stateless, windows
from rillflow.sources import tables as S

# Fixed values of the catalogue: the auctions that the selection query watches.
WATCHED = [1007, 1020, 2001, 2019, 1087]


def currency(bids: DataFrame) -> DataFrame:
    return stateless.mapper(bids, price=E.converted(F.col("price")))


def selection(bids: DataFrame, watched: list[int] = WATCHED) -> DataFrame:
    return stateless.keep(bids, F.col("auction").isin(watched))


def local_items(persons: DataFrame, auctions: DataFrame, person: Column, auction: Column) -> DataFrame:
    """name, city, state, auction of the auctions that the chosen persons sell."""
    p = stateless.keep(persons, person).select(F.col("id").alias("person_id"), "name", "city", "state")
    a = stateless.keep(auctions, auction).select(F.col("id").alias("auction"), "seller")
    return joins.incremental(a, p, F.col("seller") == F.col("person_id")).select("name", "city", "state", "auction")


def local_items_warm(persons: DataFrame, auctions: DataFrame, person: Column, auction: Column, n: int = 1000) -> DataFrame:
    """local_items over state filled ahead: n persons of negative ids with an auction each join, and are left out."""
    p = stateless.keep(persons, person).select(F.col("id").alias("person_id"), "name", "city", "state")
    a = stateless.keep(auctions, auction).select(F.col("id").alias("auction"), "seller")
    ids = persons.sparkSession.range(1, n + 1).select((-F.col("id")).alias("id"))
    p = p.unionByName(ids.select(F.col("id").alias("person_id"), *[F.lit("").alias(c) for c in ("name", "city", "state")]))
    a = a.unionByName(ids.select(F.col("id").alias("auction"), F.col("id").alias("seller")))
    return joins.incremental(a, p, F.col("seller") == F.col("person_id")).select("name", "city", "state", "auction").filter("auction >= 0")


def closed_auctions(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """id, seller, category, expires, final_price of auctions that have a bid by the time they expire."""
    own = auctions.select("id", "seller", "category", "expires")
    return joins.best_until(own, "id", "expires", bids, "auction", "bid_ts", F.max("price"), "final_price")


def category_average(closed: DataFrame, ts: str) -> DataFrame:
    """Per closed auction the average price of its category so far. Categories are few: sliced by day."""
    sums = running.running_sums(closed, ["category"], [ts, "id"], F.to_date(ts), {"total": F.col("final_price"), "n": F.lit(1).cast("long")})
    return sums.select("id", "category", F.round(F.col("total") / F.col("n"), 4).alias("avg_price"))


def seller_average(closed: DataFrame, ts: str, n: int = 10) -> DataFrame:
    """Per closed auction the average of its seller's last n prices. Sellers may be hot: sliced by month."""
    out = running.last_n(closed, ["seller"], [ts, "id"], n, {"avg_price": F.avg("final_price")}, F.trunc(ts, "month"))
    return out.select("id", "seller", F.round("avg_price", 4).alias("avg_price"))


def bid_counts(bids: DataFrame, panes: int = 3, slide: str = "4 hours") -> DataFrame:
    return windows.sliding(bids, "ts", ["auction"], panes, slide, {"c": F.count("*")}, {"bid_count": F.sum("c")}).drop("window_start")


def hot_items(bids: DataFrame, panes: int = 3, slide: str = "4 hours") -> DataFrame:
    """The auction with most bids of each window; of equals the larger id."""
    return windows.best_per_window(bid_counts(bids, panes, slide), "window_end", ["bid_count", "auction"])


def bidder_maxima(bids: DataFrame, duration: str = "6 hours") -> DataFrame:
    """Highest bid of each bidder and window; of equal bids the first."""
    first = F.min(F.struct((-F.col("price")).alias("neg"), "ts", "bid_id", "auction"))
    best = windows.tumbling(bids, "ts", ["bidder"], duration, {"b": first})
    return best.select("window_end", (-F.col("b.neg")).alias("price"), F.col("b.auction").alias("auction"), "bidder")


def highest_bid(bids: DataFrame, duration: str = "6 hours") -> DataFrame:
    """Highest bid of each window; of equals the larger auction id, then bidder."""
    return windows.best_per_window(bidder_maxima(bids, duration), "window_end", ["price", "auction", "bidder"])


def new_users(persons: DataFrame, auctions: DataFrame, period: str = "1 day") -> DataFrame:
    """Persons that open an auction within a period after they register."""
    return joins.followed_within(persons, "id", "ts", auctions, "seller", "auction_ts", period).select("id", "name", "ts")


def _persons_of_events(spark, d: str) -> DataFrame:
    e = S.load(spark, d, "events").filter("event_type = 'signup'").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("ts"))
    return e.select("id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"), "ts")


def _auctions_of_events(spark, d: str) -> DataFrame:
    return S.load(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("seller"), F.col("ts").alias("auction_ts"))


def _part_bids(spark, d: str) -> DataFrame:
    return S.load(spark, d, "lineitem").select(F.col("l_partkey").alias("auction"), F.col("l_orderkey").alias("bidder"), F.col("l_linenumber").alias("line"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"))


IN_STATE, IN_CATEGORY = "BUILDING", "1-URGENT"


def _closed(spark, d: str) -> DataFrame:
    return closed_auctions(S.auctions(spark, d), S.order_bids(spark, d))


QUERIES = {
    "q1_currency": lambda s, d: currency(S.bids(s, d)),
    "q2_selection": lambda s, d: selection(_part_bids(s, d), [7, 20, 101, 119, 187]),
    "q3_local_items": lambda s, d: local_items(S.persons(s, d), S.auctions(s, d), F.col("state") == IN_STATE, F.col("category") == IN_CATEGORY),
    "q3_deployed": lambda s, d: local_items(S.persons(s, d), S.auctions(s, d), F.col("state") != IN_STATE, F.col("category") != IN_CATEGORY),
    "q3_deployed_warm": lambda s, d: local_items_warm(S.persons(s, d), S.auctions(s, d), F.col("state") != IN_STATE, F.col("category") != IN_CATEGORY),
    "closed_auctions": _closed,
    "q4_category_average": lambda s, d: category_average(_closed(s, d), "expires"),
    "q4_mod": lambda s, d: category_average(S.closed_auctions(s, d), "ts"),
    "q5_mod_counts": lambda s, d: bid_counts(S.bids(s, d)),
    "q5_hot_items": lambda s, d: hot_items(S.bids(s, d)),
    "q6_seller_average": lambda s, d: seller_average(_closed(s, d), "expires"),
    "q6_mod": lambda s, d: seller_average(S.closed_auctions(s, d), "ts"),
    "q7_mod_bidder_maxima": lambda s, d: bidder_maxima(S.bids(s, d)),
    "q7_highest_bid": lambda s, d: highest_bid(S.bids(s, d)),
    "q8_new_users": lambda s, d: new_users(_persons_of_events(s, d), _auctions_of_events(s, d)),
}

_BIDS = "SELECT user_id AS auction, event_id % 97 AS bidder, round(value * 100)::BIGINT AS price, ts, event_id AS bid_id, props AS extra FROM events"
_CLOSED = """SELECT o_orderkey AS id, o_custkey AS seller, o_orderpriority AS category, o_orderdate + INTERVAL 365 DAY AS expires,
    max(round(l_extendedprice * 100)::BIGINT) AS final_price FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= o_orderdate + INTERVAL 365 DAY GROUP BY ALL"""
_SOURCE = "SELECT o_orderkey AS id, o_custkey AS seller, o_orderpriority AS category, o_orderdate AS ts, round(o_totalprice * 100)::BIGINT AS final_price FROM orders"
_AVG = "SELECT id, category, round(sum(final_price) OVER w / count(*) OVER w, 4) AS avg_price FROM ({}) WINDOW w AS (PARTITION BY category ORDER BY {}, id ROWS UNBOUNDED PRECEDING)"
_LAST = "SELECT id, seller, round(avg(final_price) OVER (PARTITION BY seller ORDER BY {}, id ROWS 9 PRECEDING), 4) AS avg_price FROM ({})"
_COUNTS = f"""SELECT time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 4 HOUR + INTERVAL 12 HOUR AS window_end, auction, count(*) AS bid_count
    FROM ({_BIDS}), range(3) r(k) GROUP BY ALL"""
_MAXIMA = f"""SELECT window_end, price, auction, bidder FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end FROM ({_BIDS}))
    QUALIFY row_number() OVER (PARTITION BY window_end, bidder ORDER BY price DESC, ts, bid_id) = 1"""
_LOCAL = """SELECT c_name AS name, c_nationkey::VARCHAR AS city, c_mktsegment AS state, o_orderkey AS auction FROM customer JOIN orders ON c_custkey = o_custkey
    WHERE c_mktsegment {0} 'BUILDING' AND o_orderpriority {0} '1-URGENT'"""

ORACLES = {
    "q1_currency": f"SELECT auction, bidder, trunc(price::DOUBLE * 0.85)::BIGINT AS price, ts, bid_id, extra FROM ({_BIDS})",
    "q2_selection": "SELECT l_partkey AS auction, l_orderkey AS bidder, l_linenumber AS line, round(l_extendedprice * 100)::BIGINT AS price FROM lineitem WHERE l_partkey IN (7, 20, 101, 119, 187)",
    "q3_local_items": _LOCAL.format("="),
    "q3_deployed": _LOCAL.format("<>"),
    "q3_deployed_warm": _LOCAL.format("<>"),
    "closed_auctions": _CLOSED,
    "q4_category_average": _AVG.format(_CLOSED, "expires"),
    "q4_mod": _AVG.format(_SOURCE, "ts"),
    "q5_mod_counts": _COUNTS,
    "q5_hot_items": f"SELECT window_end, bid_count, auction FROM ({_COUNTS}) QUALIFY row_number() OVER (PARTITION BY window_end ORDER BY bid_count DESC, auction DESC) = 1",
    "q6_seller_average": _LAST.format("expires", _CLOSED),
    "q6_mod": _LAST.format("ts", _SOURCE),
    "q7_mod_bidder_maxima": _MAXIMA,
    "q7_highest_bid": f"SELECT * FROM ({_MAXIMA}) QUALIFY row_number() OVER (PARTITION BY window_end ORDER BY price DESC, auction DESC, bidder DESC) = 1",
    "q8_new_users": """SELECT id, 'u' || id AS name, ts FROM (SELECT user_id AS id, min(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY 1) p
        WHERE EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.user_id = p.id AND a.ts >= p.ts AND a.ts <= p.ts + INTERVAL 1 DAY)""",
}
