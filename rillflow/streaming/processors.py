"""Keyed state and event-time timers for streams: the operators that windows and joins can't say.

Inputs are tagged with the column `input` (see operators.stateless.tagged); times are milliseconds since
the epoch, which is what Spark's timers count in. State lives in the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def keyed(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: bool = False, initial=None) -> DataFrame:
    """Runs a processor over the key's rows; timers need a watermark on df. initial prefills the state."""
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime" if timers else "None", initial)


class ClosedAuctions(StatefulProcessor):
    """When an auction expires, its best bid up to then. Rows: id, input, ts_ms, price, seller, category, expires_ms.

    Bids wait in a list only until their auction is known; from then on the best price is all that is kept.
    """

    schema = "id long, seller long, category long, final_price long, closed_ms long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.auction = handle.getValueState("auction", "seller long, category long, expires_ms long, best long")
        self.bids = handle.getListState("bids", "ts_ms long, price long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.auction.get() if self.auction.exists() else None
        bids = []
        for pdf in rows:
            lots = pdf[pdf["input"] == "auction"]
            if len(lots):
                last = lots.iloc[-1]
                held = (int(last["seller"]), int(last["category"]), int(last["expires_ms"]), held[3] if held else -1)
                self.handle.registerTimer(held[2])
            own = pdf[pdf["input"] != "auction"]
            bids += list(zip(own["ts_ms"].astype(int).tolist(), own["price"].astype(int).tolist(), strict=True))
        if held is None:
            if bids:
                self.bids.appendList(bids)
            return iter([])
        if self.bids.exists():
            bids += [(int(t), int(p)) for t, p in self.bids.get()]
            self.bids.clear()
        self.auction.update((*held[:3], max([held[3], *(p for t, p in bids if t <= held[2])])))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.auction.exists():
            seller, category, expires, best = self.auction.get()
            self.auction.clear()
            if best >= 0:
                yield pd.DataFrame([[key[0], seller, category, best, expires]], columns=["id", "seller", "category", "final_price", "closed_ms"])

    def close(self) -> None:
        pass


class NewUsers(StatefulProcessor):
    """A period after a person registers: the person, if an auction of theirs began within it. Rows: id, input, ts_ms, name."""

    schema = "id long, name string"

    def __init__(self, period_ms: int):
        self.period_ms = period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.person = handle.getValueState("person", "name string, ts_ms long")
        self.auctions = handle.getListState("auctions", "ts_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.input == "person":
                    self.person.update((r.name, int(r.ts_ms)))
                    self.handle.registerTimer(int(r.ts_ms) + self.period_ms)
                else:
                    self.auctions.appendValue((int(r.ts_ms),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.person.exists():
            name, ts = self.person.get()
            times = [t[0] for t in self.auctions.get()] if self.auctions.exists() else []
            self.person.clear()
            self.auctions.clear()
            if any(ts <= t <= ts + self.period_ms for t in times):
                yield pd.DataFrame([[key[0], name]], columns=["id", "name"])

    def close(self) -> None:
        pass


class LocalItems(StatefulProcessor):
    """The latest person of an id joined with its auctions, which wait until there is one. Rows: id, input, name, city, state, auction."""

    schema = "name string, city string, state string, auction long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.person = handle.getValueState("person", "name string, city string, state string")
        self.waiting = handle.getListState("waiting", "auction long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.input == "person":
                    self.person.update((r.name, r.city, r.state))
                    if self.waiting.exists():
                        out += [(r.name, r.city, r.state, a[0]) for a in self.waiting.get()]
                        self.waiting.clear()
                elif self.person.exists():
                    out.append((*self.person.get(), int(r.auction)))
                else:
                    self.waiting.appendValue((int(r.auction),))
        if out:
            yield pd.DataFrame(out, columns=["name", "city", "state", "auction"])

    def close(self) -> None:
        pass


class Changes(StatefulProcessor):
    """Counts a key's rows and flags those whose value differs from the one before. Rows: key, seq, value."""

    schema = "key long, seq long, n long, is_new int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long, value long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        n, last = self.last.get() if self.last.exists() else (0, None)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            n += 1
            out.append((key[0], int(r.seq), n, int(last is None or r.value != last)))
            last = int(r.value)
        self.last.update((n, last))
        yield pd.DataFrame(out, columns=["key", "seq", "n", "is_new"])

    def close(self) -> None:
        pass


class RecentMedian(StatefulProcessor):
    """Upper median of a key's last `size` values by time; an older row takes its place in the list. Rows: key, ts_ms, value."""

    schema = "key string, ts_ms long, median double, n int"

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "ts_ms long, value double")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.recent.put([(int(r.ts_ms), float(r.value)) for r in initialState.itertuples(index=False)][-self.size :])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values("ts_ms").itertuples(index=False):
            held = sorted([*held, (int(r.ts_ms), float(r.value))], key=lambda x: x[0])[-self.size :]
            values = sorted(v for ts, v in held if ts >= 0)  # prefilled rows have negative times
            if values:
                out.append((key[0], int(r.ts_ms), values[len(values) // 2], len(values)))
        self.recent.put(held)
        yield pd.DataFrame(out, columns=["key", "ts_ms", "median", "n"])

    def close(self) -> None:
        pass


class PeriodSums(StatefulProcessor):
    """Sums of two streams per key and period, when the watermark passes the period's end. Rows: key, input, ts_ms, value."""

    schema = "key long, period_end_ms long, sum1 long, sum2 long"

    def __init__(self, period_ms: int):
        self.period_ms = period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "end_ms long", "sum1 long, sum2 long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                end = (int(r.ts_ms) // self.period_ms + 1) * self.period_ms
                a, b = self.sums.getValue((end,)) if self.sums.containsKey((end,)) else (0, 0)
                self.sums.updateValue((end,), (a + int(r.value), b) if r.input == "first" else (a, b + int(r.value)))
                self.handle.registerTimer(end)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        if self.sums.containsKey((end,)):
            a, b = self.sums.getValue((end,))
            self.sums.removeKey((end,))
            yield pd.DataFrame([[key[0], end, a, b]], columns=["key", "period_end_ms", "sum1", "sum2"])

    def close(self) -> None:
        pass


class RefiringWindows(StatefulProcessor):
    """Sums of tumbling windows that fire when event time passes their end, and again for every batch with late rows
    until `lateness_ms` after it. Rows: key, ts_ms, value; the frame's watermark must lag by lateness_ms.

    firing counts a window's results from 1; the last one holds all of its rows.
    """

    schema = "key long, window_end_ms long, total long, n long, firing int"

    def __init__(self, duration_ms: int, lateness_ms: int):
        self.duration_ms, self.lateness_ms = duration_ms, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "end_ms long", "total long, n long, firing int")

    def _fire(self, key, end: int) -> pd.DataFrame:
        total, n, firing = self.sums.getValue((end,))
        self.sums.updateValue((end,), (total, n, firing + 1))
        return pd.DataFrame([[key[0], end, total, n, firing + 1]], columns=["key", "window_end_ms", "total", "n", "firing"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        late = set()
        for pdf in rows:
            ends = (pdf["ts_ms"] // self.duration_ms + 1) * self.duration_ms
            for end, own in pdf.groupby(ends)["value"]:
                end = int(end)
                total, n, firing = self.sums.getValue((end,)) if self.sums.containsKey((end,)) else (0, 0, 0)
                self.sums.updateValue((end,), (total + int(own.sum()), n + len(own), firing))
                if firing or timerValues.getCurrentWatermarkInMs() >= end - self.lateness_ms:
                    late.add(end)
                else:
                    self.handle.registerTimer(end - self.lateness_ms)
                self.handle.registerTimer(end)
        for end in sorted(late):
            yield self._fire(key, end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = at + self.lateness_ms
        if self.sums.containsKey((due,)) and not self.sums.getValue((due,))[2]:
            yield self._fire(key, due)
        if self.sums.containsKey((at,)):
            if not self.sums.getValue((at,))[2]:
                yield self._fire(key, at)
            self.sums.removeKey((at,))

    def close(self) -> None:
        pass
