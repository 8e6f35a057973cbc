"""From raw documents to shards: language, near copies, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before
it kept. All but the last return the columns of ``docs``, whatever they are;
the last returns each row's shard and place.

Defined results, for every stage: an empty table stays empty; a null id, null
source or null language doesn't drop a row; other columns pass through, whatever
their names. What each stage does with null or empty text, ties and repeated
rows is said there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm import decontamination, language_id, mixing, sharding, similar
from procura.workspace import keep, scratch

N_SHARDS = 24
#: The gain below which a text is in none of the learned languages: its trigrams are e times less likely than by
#: chance on the average. A short text of a language with a key or a number in it may come to less than 0.
MIN_GAIN = -1.0


def _free(docs: DataFrame) -> str:
    """A prefix that no column's name begins with, in any case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def _row_key(prefix: str, doc_id: Column, digest: Column) -> list[Column]:
    """An id, null included, and a hash, as columns that are never null: they join a decision to its row."""
    return [F.coalesce(doc_id, F.lit(0)).alias(f"{prefix}id"), doc_id.isNull().alias(f"{prefix}no_id"), digest.alias(f"{prefix}h")]


def _key_names(prefix: str) -> list[str]:
    return [f"{prefix}{c}" for c in ("id", "no_id", "h")]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language: null, without a letter, or in none of the learned languages.

    If no language can be learned, nothing is rejected. Repeated rows fare alike.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs
    name = _free(docs) + "language"
    found = docs.withColumn(name, language_id.identify(F.col("text"), model, spark))
    kept = (F.col(name)["lang"] != language_id.UNKNOWN) & (F.col(name)["gain"] >= MIN_GAIN)
    return found.where(kept).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays, once.

    Near copies share 0.8 or more of their five-word shingles, over any number of
    steps. Texts without words are one group. If several texts share that id, the one
    with the smallest hash stays; a group without any id keeps one row.
    """
    rows, classes = similar.near_copies(docs)
    prefix = _free(docs)
    key = _key_names(prefix)
    stays = (
        rows.join(classes, "f")
        .where(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("component")
        .agg(F.min(F.struct("id", "h")).alias("k"))
        .select(*_row_key(prefix, F.col("k.id"), F.col("k.h")))
    )
    marked = docs.select("*", *_row_key(prefix, F.col("doc_id"), F.xxhash64("text")))
    return marked.join(stays, key, "left_semi").dropDuplicates(key).drop(*key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark passages cover a twentieth or more.

    Text that is null or has no word isn't contaminated. Repeated rows fare alike.
    """
    name = _free(docs) + "hits"
    found = decontamination.measured(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name)
    n_hit = decontamination.hit_words(F.col(name))
    return found.where(~decontamination.is_contaminated(n_hit, F.col(name)["n_words"])).drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once, or up to three times.

    Rows with equal id, text and source are interchangeable: their copies are
    copies of one of them.
    """
    prefix = _free(docs)
    key, n = _key_names(prefix), f"{prefix}copies"
    copies = mixing.mix(docs).groupBy("id", "h").agg(F.sum("copies").alias(n)).where(F.col(n) > 0).select(*_row_key(prefix, F.col("id"), F.col("h")), n)
    of_row = mixing.row_hash(F.col("doc_id"), F.col("text"), F.col("source"))
    taken = docs.select("*", *_row_key(prefix, F.col("doc_id"), of_row)).join(copies, key).dropDuplicates(key)
    each = taken.withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return each.drop(*key, n, f"{prefix}copy")


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, in 24 shards of nearly equal bytes.

    A null text counts its overhead only; repeated rows have places of their own.
    """
    return sharding.shard_by_bytes(docs, N_SHARDS).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again.

    A stage's own tables go as soon as its result is written, and so does the result before.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch(spark, last):
            last = []
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}", last)
    return docs
