"""Contiguous shards of nearly equal byte size.

Rows get one total order, by the 64-bit hash of the text and then the id, so
that equal texts stand side by side. The order is dealt to range partitions;
the partitions' totals, one row each, give every partition its offset, and a
running sum inside each partition gives every row its global byte offset. The
byte line is cut at equal targets.

Defined results: a null text counts as no bytes; a null id sorts first among
equal texts; repeated rows are rows of their own; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procura.workspace import materialise, shuffle_partitions

ROW_OVERHEAD = 8


def shard_by_bytes(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", group_slack: float = 0.01
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): each row's shard and its place in it.

    ``size`` is the UTF-8 length plus 8. A cut that would fall inside a run of
    equal texts moves to the nearer end of the run if that lies within
    ``group_slack`` of a shard's target; otherwise the run is split, since
    equal sizes come first.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    raw = text.cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    # Written before the range exchange, which reads its input twice, and after
    # it, so that every later step sees the same partitions. The salt deals rows
    # that agree in all else, which may be a third of the table, to many partitions.
    narrow = materialise(rows, "shard-rows").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ordered = materialise(
        narrow.repartitionByRange(shuffle_partitions(spark), "h", "id", "size", "salt")
        .sortWithinPartitions("h", "id", "size")
        .withColumn("part", F.spark_partition_id())
        .drop("salt"),
        "shard-order",
    )
    whole_line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ordered.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(whole_line), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(whole_line), F.lit(0)).alias("rows_before"),
        )
    )
    inside = Window.partitionBy("part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ordered.withColumn("run", F.sum("size").over(inside))
        .withColumn("pos", F.row_number().over(inside))
        .join(totals, "part")
        .select(
            "id",
            "size",
            "text_crc32",
            "h",
            (F.col("bytes_before") + F.col("run") - F.col("size")).alias("start"),
            (F.col("rows_before") + F.col("pos") - 1).alias("line"),
        )
    )
    placed = materialise(placed, "shard-placed")
    total = placed.agg(F.sum("size")).first()[0] or 0
    cuts = _cuts(placed, total, n_shards, group_slack)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("start") >= F.lit(cut)).cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("line").alias("first_line")))  # n_shards rows at most
    return placed.join(first, "shard").select(
        "id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("line") - F.col("first_line")).alias("slot")
    )


def _cuts(placed: DataFrame, total: int, n_shards: int, slack: float) -> list[int]:
    """The byte offsets at which shards 1, 2, ... begin: a row belongs to the shard its first byte is in."""
    target = total / n_shards
    ideal = [round(target * k) for k in range(1, n_shards)]
    if not total:
        return ideal
    middle = F.col("start") + F.col("size") / 2
    # A row whose middle lies before the cut stays before it: cut at the nearer row end.
    hit = [F.max(F.when(middle < c, F.col("start") + F.col("size"))).alias(f"c{i}") for i, c in enumerate(ideal)]
    found = placed.agg(*hit).first()
    ideal = [found[i] if found[i] is not None else 0 for i in range(len(ideal))]
    # The runs of equal texts that contain a cut: n_shards - 1 hashes at most.
    inside = F.lit(False)
    for c in ideal:
        inside = inside | ((F.col("start") <= c) & (F.col("start") + F.col("size") >= c))
    hashes = [r["h"] for r in placed.where(inside).select("h").distinct().limit(2 * n_shards).collect()]
    runs = (
        placed.where(F.col("h").isin(hashes))
        .groupBy("h")
        .agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("size")).alias("hi"))
        .collect()
    )
    moved = []
    for c in ideal:
        ends = [e for r in runs if r["lo"] < c < r["hi"] for e in (r["lo"], r["hi"])]
        near = min(ends, key=lambda e: (abs(e - c), e), default=c)
        moved.append(near if abs(near - c) <= slack * target else c)
    return sorted(moved)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_by_bytes(docs, 24)
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
