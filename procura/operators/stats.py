"""Robust statistics of groups of prices.

Values are first counted per group and distinct value, map-side. The order
statistics then come from running counts over the distinct values in sorted
order. Groups and values are sorted together over all partitions, and a group
that lies in several takes its count before each from the partitions' totals;
so a group of any size, even one that holds most rows, spreads over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.functions.text import rounded
from procura.operators.scan import in_order, with_running_sum
from procura.workspace import materialise, shuffle_partitions


def on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on group keys in which null is a key like any other."""
    named = right.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"__key{i}" for i in range(len(keys))])


def _at(rank: Column) -> Column:
    """The value at a 0-based rank of the group."""
    return F.max(F.when((F.col("hi") - F.col("c") <= rank) & (rank < F.col("hi")), F.col("v")))


def _middle(first: Column, count: Column) -> Column:
    """The median of the ``count`` values from rank ``first`` on."""
    low = first + F.floor((count - 1) / 2)
    high = first + F.floor(count / 2)
    return (_at(low) + _at(high)) / 2


def _counts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return df.select(*keys, value.cast("double").alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))


def _ranked(counts: DataFrame, keys: list[str], *sums: str) -> DataFrame:
    """The counts with ``hi``, how many values a group has up to this one, ``n``, its values, and the sums of some columns over the group."""
    spark = counts.sparkSession
    sorted_ = counts.repartitionByRange(shuffle_partitions(spark), *keys, "v").withColumn("part", F.spark_partition_id())
    sorted_ = materialise(sorted_, "ranked-counts")
    # One row for each group and partition it lies in: about as many as groups.
    totals = sorted_.groupBy(*keys, "part").agg(F.sum("c").alias("in_part"), *[F.sum(x).alias(f"sum_{x}") for x in sums])
    group = Window.partitionBy(*keys)
    before = F.sum("in_part").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_part")
    totals = totals.select(*keys, "part", before.alias("before"), F.sum("in_part").over(group).alias("n"), *[F.sum(f"sum_{x}").over(group).alias(f"sum_{x}") for x in sums])
    upto = Window.partitionBy("part", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sorted_.withColumn("inside", F.sum("c").over(upto))
    return on_keys(placed, totals, ["part", *keys]).withColumn("hi", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def group_median(df: DataFrame, keys: list[str], value: Column, name: str = "median") -> DataFrame:
    """(keys, name): the exact median of the non-null values."""
    n = F.col("n")
    return _ranked(_counts(df, keys, value), keys).groupBy(*keys).agg(_middle(F.lit(0), n).alias(name))


def group_stats(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Statistics of the positive values of each group; groups without one are missing.

    n, mean, median, min, max, sample deviation, quartiles as medians of the two
    halves without the middle, spread (iqr), soft and hard fences at 1.5 and 3
    spreads, cv in percent, and insufficient_for_iqr (fewer than three values, or
    no spread). Where the quartiles coincide but the values differ, the spread is
    1.4826 times the median distance from the median, or a tenth of the median.
    """
    n = F.col("n")
    half = F.floor(n / 2)
    # Written once: the rare groups without a spread read the counts again.
    counts = materialise(_counts(df.where(value > 0), keys, value).withColumn("vc", F.col("v") * F.col("c")), "price-counts")
    counted = _ranked(counts, keys, "vc").withColumn("mean", F.col("sum_vc") / n)
    base = counted.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("mean").alias("mean"),
        _middle(F.lit(0), n).alias("median"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.coalesce(F.sqrt(F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), 2)) / F.nullif(F.max("n") - 1, F.lit(0))), F.lit(0.0)).alias("stdev"),
        F.coalesce(_middle(F.lit(0), half), F.max("v")).alias("q1"),
        F.coalesce(_middle(n - half, half), F.max("v")).alias("q3"),
        (F.min(F.round("v", 2)) == F.max(F.round("v", 2))).alias("same"),
    )
    base = materialise(base, "price-stats")
    flat = base.where("q3 <= q1 and not same").select(*keys, "median")
    if flat.isEmpty():
        return _with_fences(base.withColumn("mad", F.lit(None).cast("double")), keys)
    away = on_keys(counts, flat, keys).groupBy(*keys, F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("c").alias("c"))
    near = _ranked(away, keys).groupBy(*keys).agg(_middle(F.lit(0), n).alias("mad"))
    return _with_fences(on_keys(base, near, keys, "left"), keys)


def _with_fences(base: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics from the order statistics and, of groups without a spread, the distance ``mad``."""
    n = F.col("n")
    spread = (
        F.when(F.col("q3") > F.col("q1"), F.col("q3") - F.col("q1"))
        .when(F.col("same"), 0.0)
        .when(F.col("mad") > 0, F.col("mad") * 1.4826)
        .otherwise(F.col("median") * 0.1)
    )
    out = base.withColumn("iqr", F.when(n < 2, 0.0).otherwise(spread))
    return out.select(
        *keys, "n", "mean", "median", "min", "max", "stdev", "q1", "q3", "iqr",
        (F.col("q1") - 1.5 * F.col("iqr")).alias("fence_soft_lo"),
        (F.col("q3") + 1.5 * F.col("iqr")).alias("fence_soft_hi"),
        (F.col("q1") - 3.0 * F.col("iqr")).alias("fence_hard_lo"),
        (F.col("q3") + 3.0 * F.col("iqr")).alias("fence_hard_hi"),
        F.when((n > 1) & (F.col("mean") > 0), F.round(F.col("stdev") / F.col("mean") * 100, 1)).otherwise(0.0).alias("cv"),
        ((n < 3) | (F.col("iqr") == 0)).alias("insufficient_for_iqr"),
    )


def effective_price(median_quantity: Column | None = None) -> Column:
    """The unit price, else total over quantity, else 0; a missing quantity may be imputed."""
    quantity = F.coalesce("quantity", F.lit(0.0))
    if median_quantity is not None:
        quantity = F.when(quantity == 0, F.coalesce(median_quantity, F.lit(0.0))).otherwise(quantity)
    total = F.coalesce("total_price", F.lit(0.0))
    return (
        F.when(F.coalesce("unit_price", F.lit(0.0)) > 0, F.col("unit_price"))
        .when((total > 0) & (quantity > 0), rounded(total / F.nullif(quantity, F.lit(0.0)), 2))
        .otherwise(0.0)
    )


def price_class(price: Column, s: Column) -> Column:
    """strong_outlier, moderate_deviation, normal or insufficient_data, against a statistics struct."""
    return (
        F.when(s["n"].isNull() | (s["n"] < 2) | (price <= 0) | (s["iqr"] == 0), "insufficient_data")
        .when((price < s["fence_hard_lo"]) | (price > s["fence_hard_hi"]), "strong_outlier")
        .when((price < s["fence_soft_lo"]) | (price > s["fence_soft_hi"]), "moderate_deviation")
        .otherwise("normal")
    )


def price_position(price: Column, s: Column) -> Column:
    low = price < s["median"]
    kind = price_class(price, s)
    return (
        F.when(s["n"].isNull() | (s["n"] < 2) | (price <= 0), "unknown")
        .when(s["iqr"] == 0, "iqr_zero")
        .when(kind == "strong_outlier", F.when(low, "outlier_low").otherwise("outlier_high"))
        .when(kind == "moderate_deviation", F.when(low, "below_fence").otherwise("above_fence"))
        .otherwise("in_range")
    )


STATS = ["n", "mean", "median", "min", "max", "stdev", "q1", "q3", "iqr", "fence_soft_lo", "fence_soft_hi", "fence_hard_lo", "fence_hard_hi", "cv", "insufficient_for_iqr"]


def classify_prices(items: DataFrame, keys: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Every item with a price, its class, position, z-score and distance from the group's median.

    ``stats`` are the groups' statistics, if they are known.
    """
    stats = group_stats(items.withColumn("price", effective_price()), keys, F.col("price")) if stats is None else stats
    packed = stats.select(*keys, F.struct(*STATS).alias("s"))
    s, price = F.col("s"), F.col("price")
    known = (s["n"] >= 2) & (price > 0)
    away = F.abs(price - s["median"])
    return (
        items.withColumn("price", effective_price())
        .transform(on_keys, packed, keys)
        .where((price > 0) & (s["n"] >= 2))
        .withColumn("classification", price_class(price, s))
        .withColumn("iqr_position", price_position(price, s))
        .withColumn("abs_deviation", F.when(known, F.round(away, 2)).otherwise(0.0))
        .withColumn("pct_deviation", F.when(known & (s["median"] != 0), F.round(away / s["median"] * 100, 2)).otherwise(0.0))
        .withColumn("z_score", F.when(known & (s["stdev"] > 0), F.round((price - s["mean"]) / s["stdev"], 2)).otherwise(0.0))
    )


def price_trend(items: DataFrame, keys: list[str]) -> DataFrame:
    """Mean price of the last third of a group's dated purchases against the first third.

    Needs three dated and priced items; equal dates keep the items' order.
    """
    return _trend(priced_items(items, keys), keys)


def priced_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ordinal, date, price) of the items with a price, written once."""
    priced = items.select(*keys, "ordinal", "date", effective_price().alias("price")).where("price > 0")
    return materialise(priced, "priced-items", "zstd")


def _trend(priced: DataFrame, keys: list[str]) -> DataFrame:
    """``price_trend`` of ``priced_items``: whole months are summed; only months in which a third ends are put in order."""
    order, monthly, n, third = ["date", "ordinal"], [*keys, "month"], F.col("n"), F.col("third")
    dated = priced.where("date is not null").withColumn("month", F.year("date") * 12 + F.month("date"))
    months = dated.groupBy(*monthly).agg(F.count(F.lit(1)).alias("c"), F.sum("price").alias("s"), F.min("date").alias("from"), F.max("date").alias("to"))
    group = Window.partitionBy(*keys)
    before = F.sum("c").over(group.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    months = months.withColumns({"low": before, "n": F.sum("c").over(group)}).where("n >= 3").withColumn("third", F.greatest(F.floor(n / 3), F.lit(1)))
    # How many of a month's items come before the first third's end, and before the last third's beginning.
    inside = {"first": F.least(F.greatest(third - F.col("low"), F.lit(0)), F.col("c")), "last": F.least(F.greatest(n - third - F.col("low"), F.lit(0)), F.col("c"))}
    months = materialise(months.withColumns(inside), "trend-months")
    cut = months.where("first between 1 and c - 1 or last between 1 and c - 1").select(*monthly, "first", "last")
    rows = in_order(on_keys(dated.select(*monthly, *order, "price"), cut, monthly), monthly, order)
    ranked = with_running_sum(rows, monthly, order, F.lit(1), "rn")
    ends = ranked.groupBy(*monthly).agg(
        F.sum(F.when(F.col("rn") <= F.col("first"), F.col("price"))).alias("first_part"), F.sum(F.when(F.col("rn") > F.col("last"), F.col("price"))).alias("last_part")
    )
    whole = lambda share, part: F.when(share, F.col("s")).otherwise(F.coalesce(F.col(part), F.lit(0.0)))
    both = on_keys(months, ends, monthly, "left").groupBy(*keys).agg(
        (F.sum(whole(F.col("first") == F.col("c"), "first_part")) / F.max("third")).alias("first_mean"),
        (F.sum(whole(F.col("last") == 0, "last_part")) / F.max("third")).alias("last_mean"),
        F.min("from").alias("date_from"),
        F.max("to").alias("date_to"),
        F.max("n").alias("observations"),
    )
    change = F.round((F.col("last_mean") - F.col("first_mean")) / F.nullif("first_mean", F.lit(0.0)) * 100, 1)
    return both.withColumn("change_pct", change).where("change_pct is not null").select(
        *keys,
        F.when(F.col("change_pct") > 15, "growing").when(F.col("change_pct") < -15, "declining").otherwise("stable").alias("direction"),
        "change_pct", F.round("first_mean", 2).alias("avg_first"), F.round("last_mean", 2).alias("avg_last"), "date_from", "date_to", "observations",
    )


def group_price_analysis(items: DataFrame, keys: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Statistics, number of outliers and deviations, trend and spread signal of every group."""
    priced = priced_items(items, keys)  # three passes read it
    stats = group_stats(priced, keys, F.col("price")) if stats is None else stats
    # A price that is known needs neither quantity nor total.
    none = F.lit(None).cast("double")
    classes = classify_prices(priced.select(*keys, F.col("price").alias("unit_price"), none.alias("quantity"), none.alias("total_price")), keys, stats).groupBy(*keys).agg(
        F.count_if(F.col("classification") == "strong_outlier").alias("outlier_count"),
        F.count_if(F.col("classification") == "moderate_deviation").alias("deviation_count"),
    )
    trend = _trend(priced, keys).select(*keys, "direction", "change_pct")
    return (
        on_keys(on_keys(stats, classes, keys, "left"), trend, keys, "left")
        .fillna(0, ["outlier_count", "deviation_count"])
        .withColumn("cv_signal", F.col("cv") > 30)
    )


def total_anomalies(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose total exceeds three times the median total of a group of three or more totals."""
    positive = items.where("total_price > 0")
    n = positive.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_totals")).where("n_totals >= 3")
    median = group_median(positive, keys, F.col("total_price"), "median_total")
    return on_keys(on_keys(positive, n, keys), median, keys).where("total_price > 3 * median_total").drop("n_totals")


def inconsistent_items(items: DataFrame) -> DataFrame:
    """Items whose price times quantity misses the total by more than 5 % of it."""
    expected = F.col("quantity") * F.col("unit_price")
    off = F.abs(expected - F.col("total_price")) / F.nullif("total_price", F.lit(0.0))
    return (
        items.where("quantity > 0 and unit_price > 0 and total_price > 0")
        .withColumn("expected", F.round(expected, 2))
        .withColumn("diff_pct", F.round(off * 100, 1))
        .where(off > 0.05)
    )
