"""Purchases as they come: running price history with state, and hasty purchases by an interval join."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura import constants as C
from procura.operators.patterns import interval_pairs
from procura.operators.scan import in_order, with_previous, with_running_sum

FORGET_DAYS = 365
HISTORY = "name string, seq long, ts timestamp, price double, n long, mean double, previous double, change_pct double"
STATE = "n long, total double, last double, last_us long"


def running_prices(purchases: DataFrame, forget_days: int = FORGET_DAYS, late: str = "7 days") -> DataFrame:
    """Every purchase (name, seq, ts, price) with its name's history so far: number and mean of prices, the one before, the change in percent.

    On a stream, a name's history is state: four numbers, whatever its length. It is
    forgotten when the next purchase comes more than ``forget_days`` later; the state goes as soon as the
    watermark is past that day. Purchases of one batch are taken by time and ``seq``, batches as they
    come; rows behind the watermark are dropped. On a table, where all rows are there,
    the result is that of a stream whose batches come in order. Rows without a
    name, a time or a positive price take no part.
    """
    rows = purchases.select("name", "seq", "ts", "price").where("name <> '' and ts is not null and price > 0")
    return _stream_history(rows, forget_days, late) if rows.isStreaming else _table_history(rows, forget_days)


def _table_history(rows: DataFrame, forget_days: int) -> DataFrame:
    order, keys = ["ts", "seq"], ["name"]
    gap = F.unix_micros("ts") - F.unix_micros("before.ts")
    new = F.coalesce((gap > forget_days * 86_400_000_000).cast("int"), F.lit(0))
    spans = with_running_sum(with_previous(in_order(rows, keys, order), keys, order, ["ts", "price"], "before"), keys, order, new, "span")
    # Within a span the row before is the row before in all: only a span's first has none.
    spans = spans.withColumn("previous", F.when(new == 0, F.col("before.price"))).drop("before", "__part")
    own = ["name", "span"]
    ranged = in_order(spans, own, order)
    counted = with_running_sum(with_running_sum(ranged, own, order, F.lit(1).cast("long"), "n"), own, order, F.col("price"), "total")
    return counted.select(*_columns(F.col("total") / F.col("n")))


def _columns(mean):
    change = F.round((F.col("price") - F.col("previous")) / F.col("previous") * 100, 2)
    return ["name", "seq", "ts", "price", "n", mean.alias("mean"), "previous", change.alias("change_pct")]


def _stream_history(rows: DataFrame, forget_days: int, late: str) -> DataFrame:
    forget = forget_days * 86_400_000_000

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last, last_us = state.get if state.exists else (0, 0.0, None, None)
        pdf = pd.concat(list(parts)).sort_values(["ts", "seq"], kind="stable")
        out = []
        for seq, ts, price in zip(pdf["seq"], pdf["ts"], pdf["price"], strict=True):
            now = pd.Timestamp(ts).value // 1000
            if last_us is not None and now - last_us > forget:
                n, total, last = 0, 0.0, None
            out.append((key[0], seq, ts, price, n + 1, (total + price) / (n + 1), last))
            n, total, last = n + 1, total + price, price
            last_us = now if last_us is None else max(now, last_us)
        state.update((n, total, last, last_us))
        state.setTimeoutTimestamp(max((last_us + forget) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["name", "seq", "ts", "price", "n", "mean", "previous"])

    marked = rows.withWatermark("ts", late)
    schema = HISTORY.replace(", change_pct double", "")
    found = marked.groupBy("name").applyInPandasWithState(update, schema, STATE, "append", "EventTimeTimeout")
    return found.select(*_columns(F.col("mean")))


def hasty_purchases(purchases: DataFrame, days: tuple[int, int] = C.INTERVAL_DAYS, late: str = "2 days") -> DataFrame:
    """(name, date1, date2, interval_days): neighbouring purchase days of one name (name, ts), so many days apart.

    A stream is joined with itself: purchases of a name wait for later ones as long as
    these can come within the interval, then their state goes. Of the days before a purchase the last
    counts, known once the watermark has passed the purchase. Rows later than
    ``late`` may be dropped. A table is scanned in order instead, as in ``interval_pairs``.
    """
    named = purchases.where("name <> '' and ts is not null")
    if not named.isStreaming:
        items = named.select(F.col("name").alias("canonical_name"), "name", F.to_date("ts").alias("date"), F.lit(0).alias("ordinal"))
        return interval_pairs(items, days).select("name", "date1", "date2", "interval_days")
    day = F.date_trunc("day", "ts")
    first = named.select(F.col("name").alias("n1"), day.alias("t1")).withWatermark("t1", late)
    then = named.select("name", day.alias("t2")).withWatermark("t2", late)
    least, most = (F.expr(f"interval {d} days") for d in days)
    met = then.join(first, (F.col("name") == F.col("n1")) & (F.col("t2") >= F.col("t1") + least) & (F.col("t2") <= F.col("t1") + most))
    nearest = met.groupBy("name", F.window("t2", "1 day").alias("w")).agg(F.max("t1").alias("t1"))
    date1, date2 = F.to_date("t1"), F.to_date("w.start")
    return nearest.select("name", date1.alias("date1"), date2.alias("date2"), F.datediff(date2, date1).alias("interval_days"))

