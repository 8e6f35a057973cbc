"""The item table of the driver's star schema, and plain readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above so many orders the planner can't broadcast them; then each task holds its share of the orders and sorts no lines.
MANY_ORDERS = 1_000_000


def ordinal(order: Column, line: Column, part: Column, supplier: Column) -> Column:
    """The input order as one number: order, line, part, supplier."""
    wide = "decimal(38,0)"
    return (
        order.cast(wide) * F.lit(10**16).cast("decimal(17,0)") + line.cast("decimal(3,0)") * F.lit(10**15).cast("decimal(16,0)")
        + part.cast("decimal(12,0)") * F.lit(10**5).cast("decimal(6,0)") + supplier % 100_000
    ).cast(wide)


def items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as procurement items; ``ordinal`` is the input order."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines, orders, customers, parts, suppliers = (read(t) for t in ("lineitem", "orders", "customer", "part", "supplier"))
    # What lines carry to the join is narrow; customers are joined to many orders before these, to few after them.
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("l_date"))
    many = orders.count() > MANY_ORDERS
    bought, same = F.col("o_custkey") == F.col("c_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    both = orders.join(customers, bought).select("o_orderkey", "c_mktsegment")
    return (
        (lines.join(both.hint("shuffle_hash"), same) if many else lines.join(orders, same).join(customers, bought))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            ordinal(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("ordinal"),
            F.col("p_name").alias("name"),
            F.col("s_name").alias("contractor"),
            F.col("c_mktsegment").alias("department"),
            F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("source_file"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_extendedprice").alias("total_price"),
            F.col("l_date").alias("date"),
            F.lower("p_type").alias("unit"),
            F.col("p_brand").alias("brand"),
        )
    )


DOCUMENT = (
    "filename string, source_file string, department string, contractor string, date string, raw_text string, "
    "metadata map<string,string>, items array<struct<name:string,quantity:string,unit:string,unit_price:string,"
    "total_price:string,price:string,amount:string,inn:string,contractor:string,date:string,source_file:string,department:string>>"
)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their items, one JSON object a line."""
    return spark.read.schema(DOCUMENT).json(path)


def infer_roles(df: DataFrame) -> dict[str, str]:
    """Which column of a table is the item, quantity, price and total, by one aggregation.

    The text column with the longest values is the item; of all ordered triples of
    numeric columns the one whose product misses least is quantity, price, total.
    """
    from itertools import permutations

    from procura.functions.text import plain_number

    numbers = {c: plain_number(F.col(f"`{c}`")) for c in df.columns}
    row = df.agg(
        *[F.avg(F.char_length(F.col(f"`{c}`").cast("string"))).alias(f"l_{i}") for i, c in enumerate(df.columns)],
        *[F.avg(n.isNotNull().cast("int")).alias(f"n_{i}") for i, n in enumerate(numbers.values())],
        *[F.avg(n).alias(f"m_{i}") for i, n in enumerate(numbers.values())],
    ).first()
    numeric = [i for i in range(len(df.columns)) if (row[f"n_{i}"] or 0) >= 0.5]
    texts = [i for i in range(len(df.columns)) if i not in numeric]
    roles = {"name": df.columns[max(texts, key=lambda i: (row[f"l_{i}"] or 0, -i))]} if texts else {}
    if len(numeric) < 3:
        return roles
    triples = list(permutations(numeric, 3))
    cols = [numbers[c] for c in df.columns]
    misses = df.agg(*[F.avg(F.abs(cols[a] * cols[b] - cols[t]) / (F.abs(cols[t]) + 1e-6)).alias(f"t{k}") for k, (a, b, t) in enumerate(triples)]).first()
    best = min(range(len(triples)), key=lambda k: (misses[k] if misses[k] is not None else float("inf"), k))
    total = triples[best][2]
    price, quantity = sorted(triples[best][:2], key=lambda i: -(row[f"m_{i}"] or 0))
    return roles | {"quantity": df.columns[quantity], "unit_price": df.columns[price], "total_price": df.columns[total]}


def attach_source(items: DataFrame, filename: str) -> DataFrame:
    """Items with the file they come from and the department its name tells."""
    from procura.functions.text import department_of, plain_filename

    name = plain_filename(F.lit(filename))
    return items.withColumn("source_file", name).withColumn("department", department_of(name))
