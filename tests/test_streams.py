"""Streams of purchases against the same rows as a table, over restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from procura.operators import stores
from procura.sources.event_log import EventLog
from procura.streaming import purchases

SCHEMA = "name string, seq long, ts timestamp, price double"
START = dt.datetime(2020, 1, 1)


def rows_of(n, names=("a", "b", "c"), seed=1, step=3):
    rng, out, day = random.Random(seed), [], 0
    for i in range(n):
        day += rng.randint(0, step)
        out.append((rng.choice(names), i, START + dt.timedelta(days=day), float(rng.randint(1, 50))))
    return out


def run_in_batches(spark, make, batches, folder):
    """Each batch is a file that a query started anew finds; it goes on from the checkpoint of the one before."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    return spark.read.parquet(f"{folder}/out")


def plain(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_price_history_on_a_stream_is_that_of_the_table(spark, tmp_path):
    """Three runs from one checkpoint; one name is forgotten between two of its purchases."""
    rows = rows_of(40) + [("a", 100, START + dt.timedelta(days=700), 5.0), ("a", 101, START + dt.timedelta(days=701), 10.0)]
    odd = [("", 200, START, 1.0), (None, 201, START, 1.0), ("a", 202, None, 1.0), ("a", 203, START, 0.0), ("a", 204, START, None)]
    got = run_in_batches(spark, lambda s: purchases.running_prices(s, 365, "400 days"), [rows[:15] + odd, rows[15:40], rows[40:]], str(tmp_path))
    table = purchases.running_prices(spark.createDataFrame(rows + odd, SCHEMA), 365)
    assert plain(got.select(table.columns)) == plain(table)
    of = {r["seq"]: r for r in table.collect()}
    assert len(of) == len(rows) and (of[100]["n"], of[100]["previous"], of[101]["n"], of[101]["change_pct"]) == (1, None, 2, 100.0)


def test_running_prices_of_a_hot_name(spark):
    rows = [("hot" if i % 10 else "cold", i, START + dt.timedelta(hours=i), float(i % 7 + 1)) for i in range(2000)]
    got = {r["seq"]: r for r in purchases.running_prices(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    seen = {"hot": [], "cold": []}
    for name, seq, _, price in rows:
        before = seen[name][-1] if seen[name] else None
        seen[name].append(price)
        assert (got[seq]["n"], got[seq]["previous"]) == (len(seen[name]), before)
        assert abs(got[seq]["mean"] - sum(seen[name]) / len(seen[name])) < 1e-9


def test_hasty_purchases_on_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = rows_of(60, seed=4, step=2)
    far = [("end", 999, START + dt.timedelta(days=4000), 1.0)]  # moves the mark past all of them
    got = run_in_batches(spark, purchases.hasty_purchases, [rows[:25], rows[25:], far, [("end", 1000, START + dt.timedelta(days=4100), 1.0)]], str(tmp_path))
    table = purchases.hasty_purchases(spark.createDataFrame(rows, SCHEMA))
    assert table.count() > 10
    assert plain(got.select(table.columns)) == plain(table)


def test_event_log_keeps_what_two_writers_append(spark, tmp_path):
    """Claims are taken before either writes; a snapshot between them loses neither; a batch sent again changes nothing."""
    log = EventLog(spark, str(tmp_path / "log"), stores.PRICE)
    assert log.read().count() == 0 and log.compact() == 0
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "item_name string, price double")
    first, second = log._claim("w1-0"), EventLog(spark, str(tmp_path / "log"), stores.PRICE)._claim("w2-0")
    assert first != second
    assert log.append(one.withColumn("extra", F.lit(1)), "w2-0", ["price"]) == second
    assert log.compact() == second and log._manifest()["missing"] == [first]
    assert log.append(one.withColumn("price", F.col("price") * 10), "w1-0", ["price"]) == first
    assert log.append(one, "w1-0") == first and log.append(one, "w2-0") == second
    third = log.add(item_name="b", price=5.0)
    read = lambda: [(r["item_name"], r["price"]) for r in log.read().orderBy("seq").collect()]
    want = [("a", 10.0), ("a", 20.0), ("a", 1.0), ("a", 2.0), ("b", 5.0)]
    assert read() == want and third == 3
    assert log.compact() == third and read() == want
    assert log.append(one, "w1-0") == first and log.compact() == third and read() == want
    assert log.append(one.limit(0), "empty") == 4 and read() == want and log.compact() == 4 and read() == want
    assert log.read().select("seq").distinct().count() == 5


def test_event_log_behind_a_stream(spark, tmp_path):
    """Three runs from one checkpoint, a snapshot between them, the last batch sent twice."""
    log = EventLog(spark, str(tmp_path / "log"), stores.PRICE)
    schema = "item_name string, price double"
    put = log.sink("prices", ["price"])
    seen = []

    def both(batch, batch_id):
        seen.append((batch.collect(), batch_id))
        put(batch, batch_id)

    for run in range(3):
        spark.createDataFrame([(f"i{run}", float(run)), ("x", float(run))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        if run == 1:
            log.compact()
    rows, batch_id = seen[-1]
    put(spark.createDataFrame(rows, schema), batch_id)
    assert sorted((r["item_name"], r["price"]) for r in log.read().collect()) == [("i0", 0.0), ("i1", 1.0), ("i2", 2.0), ("x", 0.0), ("x", 1.0), ("x", 2.0)]
