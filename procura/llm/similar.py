"""Groups of documents whose sets of word shingles are similar, each link checked on the shingles.

The near-copy rule on shingle sets: five words, Jaccard similarity 0.8 or more.
The first candidates are those of ``simhash``: fingerprints within its radius, found
by its covering masks. A SimHash of 64 bits can't find all pairs at a bounded
cost: at similarity 0.8 two fingerprints differ in ten bits on the average, and
covering masks for that radius are some thousand tables for each row. So further
candidates are texts that agree in one of ``BANDS`` bands of ``DEPTH`` minimum hashes; a pair of similarity 0.8
does with probability 1 - (1 - 0.8**5)**25 = 0.99995, a more similar one more
surely.

Families of texts with a similarity of, say, 0.6 share many bands and would
cost all their pairs. Most of them go beforehand, without loss: a text that has
more than a fifth of its shingles for itself alone, among all candidates, is
similar to no other. Of the rest each text is compared with the one text of its
buckets that has the smallest share of shingles for itself, which in a family is
the text that the others were copied from; then those outside a bucket's largest
group with that group's first text. What is linked by then needs no comparison.

Texts of buckets that still hold several groups meet once more, at shingles:
with shingles in one order, rarest first, two sets of similarity 0.8 share one
of the first size - ceil(0.8 * size) + 1 of each. A shingle that many texts
offer is mostly one group's, inside which nobody meets. The shingles of the texts
that others were compared with stand last in the order. So two texts that meet
first at one of those share no other kind, at most as many as the smaller number
of them that either has; and two texts that meet first at some places of their
orders share no more than what follows there. If either is too few for both
sizes, they don't meet. In a family all of whose members differ from the first a little too much, they
meet at what they share beside it, or not at all. This step loses no pair
either. So a bucket of any size ends with its groups and no pair of different
groups goes unchecked.

Defined results: as in ``simhash``, with the hash of the shingle set in place of
the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procura.llm.simhash import SEED, links, majority, shingle_digests
from procura.operators.components import connected_components
from procura.workspace import materialise

WORDS = 5
SIMILARITY = 0.8
BANDS, DEPTH = 25, 5
#: Odd factors and summands of the hash functions.
_RNG = np.random.default_rng(20240601)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SUMMANDS = _RNG.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64)
#: Shingles hashed at once, and pairs of one text that a task compares.
BLOCK, PAIRS = 4096, 512


def shingles(raw: bytes | None) -> np.ndarray:
    """The set of shingle digests, sorted."""
    return _distinct(shingle_digests(raw or b"", WORDS))


def _distinct(digests: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(digests), dtype=np.uint64))


def bands(own: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> list[int]:
    """A hash for each band of the minima; of no shingle none."""
    if not len(own):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), BLOCK):
        least = np.minimum(least, (own[at : at + BLOCK, None] * factors + summands).min(axis=0))
    raw, step = least.tobytes(), 8 * DEPTH
    return [xxhash.xxh64_intdigest(raw[at : at + step], SEED) - (1 << 63) for at in range(0, len(raw), step)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= SIMILARITY * (len(a) + len(b) - common)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, f, size, p, bands): f is the hash of the shingle set, 0 without words; size counts its shingles; p is the fingerprint."""

    factors, summands = FACTORS, SUMMANDS

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part:
                digests = shingle_digests(text or b"", WORDS)
                own = _distinct(digests)
                rows.append((xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63) if len(own) else 0, len(own), majority(digests), bands(own, factors, summands)))
            yield pd.DataFrame(rows, columns=["f", "size", "p", "bands"]).astype({"f": "int64", "size": "int64", "p": "int64"})

    found = F.pandas_udf(batches, "f long, size long, p long, bands array<long>")(F.col(text_col).cast("binary"))
    out = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), found.alias("s"))
    return materialise(out.select("id", "h", "s.f", "s.size", "s.p", "s.bands"), "similar-rows")


def _near_prints(prints: DataFrame) -> DataFrame:
    """(a, b): texts of one fingerprint, or of two that ``simhash`` links, by the first text of each; texts without words aside."""
    said = prints.where("size > 0").select("f", "p")
    first = materialise(said.groupBy("p").agg(F.min("f").alias("first")), "similar-prints")
    equal = said.join(first, "p").where("f <> first").select(F.col("first").alias("a"), F.col("f").alias("b"))
    linked = links(first.select(F.col("p").alias("f")))
    ends = [first.select(F.col("p").alias(c), F.col("first").alias(n)) for c, n in (("a", "fa"), ("b", "fb"))]
    return materialise(equal.unionByName(linked.join(ends[0], "a").join(ends[1], "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))).distinct(), "similar-near")


def _each_shingle(texts: DataFrame) -> DataFrame:
    """(shingle, f) of texts (f, raw)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingles(raw).view(np.int64)
                for at in range(0, len(own), 100_000):
                    part = own[at : at + 100_000]
                    yield pa.record_batch([pa.array(part), pa.array(np.full(len(part), f, dtype=np.int64))], names=["shingle", "f"])

    return texts.select("f", "raw").mapInArrow(spread, "shingle long, f long")


def _alone(texts: DataFrame) -> DataFrame:
    """(f, alone): how many shingles of a text stand in no other."""
    once = _each_shingle(texts).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f")).where("n = 1")
    return once.groupBy("f").agg(F.count(F.lit(1)).alias("alone"))


def _rare_pairs(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): pairs of different groups (f, size, c, head) that may be similar, by the first shingles of each."""
    each = _each_shingle(texts.join(groups.select("f"), "f", "left_semi")).join(groups.select("f", "head"), "f")
    each = materialise(each, "similar-shingles")
    counts = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.max("head").alias("known")).where("n > 1")
    # A shingle of one text alone comes first in the order, takes its place and meets nobody.
    shared = each.drop("head").join(counts, "shingle").join(groups.drop("head"), "f")
    own = Window.partitionBy("f")
    single = F.col("size") - F.count(F.lit(1)).over(own)
    first = F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1
    placed = shared.withColumn("r", F.row_number().over(own.orderBy("known", "n", "shingle")) + single).withColumn("most", F.sum(F.col("known").cast("int")).over(own))
    offered = materialise(placed.where(F.col("r") <= first).select("shingle", "f", "c", "size", "known", "most", (F.col("size") - F.col("r") + 1).alias("rest")), "similar-offered")
    sizes = offered.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("shingle").agg(F.max(F.struct("n", "c")).alias("m"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    largest = largest.select("shingle", F.col("m.c").alias("largest"))
    minor = offered.join(largest, "shingle").where("c <> largest").select("shingle", F.col("f").alias("a"), F.col("c").alias("ca"), F.col("size").alias("sa"), F.col("most").alias("ma"), F.col("rest").alias("ra"))
    near = (F.least("size", "sa") >= SIMILARITY * F.greatest("size", "sa") - 1e-9) & (F.col("ca") != F.col("c"))
    common = SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("sa")) - 1e-9
    enough = (F.least("rest", "ra") >= common) & (~F.col("known") | (F.least("most", "ma") >= common))
    return minor.join(offered, "shingle").where(near & enough).select("a", F.col("f").alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[bytes, np.ndarray] = {}
        for left, right in parts:
            out = []
            for a, b in zip(left, right, strict=True):
                if a not in known:
                    known = {a: shingles(a)}
                out.append(similar(known[a], shingles(b)))
            yield pd.Series(out, dtype="bool")

    # A text of many pairs goes to several tasks, ``PAIRS`` to each about.
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("parts"))
    left = texts.join(parts, texts["f"] == parts["a"]).select("a", F.col("raw").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
    both = dealt.join(texts.select(F.col("f").alias("b"), F.col("raw").alias("y")), "b").join(left, ["a", "part"])
    return both.where(F.pandas_udf(batches, "boolean")("x", "y")).select("a", "b")


def _labelled(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that still hold several groups, with their group; and the groups."""
    component = materialise(connected_components(edges), "similar-components")
    named = members.drop("c").join(component, members["f"] == component["node"], "left").select("band", "key", "share", "f", F.coalesce("component", "f").alias("c"))
    mixed = named.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band", "key")
    return materialise(named.join(mixed, ["band", "key"]), "similar-members"), component


def _linked(pairs: DataFrame, texts: DataFrame, component: DataFrame | None) -> DataFrame:
    """The similar ones of the pairs (a, b), and what earlier rounds linked."""
    wanted = materialise(pairs.distinct(), "similar-pairs")
    found = _verified(wanted, texts)
    if component is not None:
        found = found.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return materialise(found, "similar-edges")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes) as ``simhash.near_duplicates`` gives them, f being the hash of the shingle set."""
    rows = _signed(docs, id_col, text_col)
    prints = rows.groupBy("f").agg(F.min("id").alias("first_id"), F.min("h").alias("h"), F.max("size").alias("size"), F.min("p").alias("p"), F.first("bands").alias("bands"))
    prints = materialise(prints, "similar-distinct")
    spread = prints.select("f", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    members = materialise(spread.join(shared, ["band", "key"]), "similar-members")
    near = _near_prints(prints)
    asked = members.select("f").unionByName(near.select(F.col("a").alias("f"))).unionByName(near.select(F.col("b").alias("f"))).distinct()
    wanted = prints.join(asked, "f", "left_semi").select("f", "h", "size")
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("raw")).join(wanted, "h")
    texts = materialise(texts.dropDuplicates(["f"]), "similar-texts")
    share = F.coalesce("alone", F.lit(0)) / F.col("size")
    able = texts.select("f", "size").join(_alone(texts), "f", "left").select("f", share.alias("share")).where(F.col("share") <= 1 - SIMILARITY + 1e-9)
    members = materialise(members.join(able, "f").withColumn("c", F.col("f")), "similar-members")
    bucket = ["band", "key"]
    first = F.struct("share", "f")
    # Each text with the best of the first members of its buckets.
    heads = members.groupBy(*bucket).agg(F.min(first).alias("head"))
    best = members.join(heads, bucket).where("f <> head.f").groupBy("f").agg(F.min("head").alias("head"))
    edges = _linked(best.select(F.col("head.f").alias("a"), F.col("f").alias("b")).unionByName(near), texts, None)
    members, component = _labelled(members, edges)
    # Those outside a bucket's largest group with the first text of that group, the best of all their buckets.
    sizes = members.groupBy(*bucket, "c").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("head"))
    most = sizes.groupBy(*bucket).agg(F.max(F.struct("n", "c", "head")).alias("most")).select(*bucket, F.col("most.c").alias("most"), F.col("most.head").alias("head"))
    best = members.join(most, bucket).where("c <> most").groupBy("f").agg(F.min("head").alias("head"))
    best = materialise(best.select(F.col("head.f").alias("a"), F.col("f").alias("b")), "similar-best")
    edges = _linked(best, texts, component)
    members, component = _labelled(members, edges)
    heads = best.select(F.col("a").alias("f")).distinct().withColumn("head", F.lit(True))
    groups = members.select("f", "c").distinct().join(prints.select("f", "size"), "f").join(heads, "f", "left")
    groups = materialise(groups.withColumn("head", F.coalesce("head", F.lit(False))), "similar-groups")
    if not groups.isEmpty():
        pairs = _rare_pairs(texts, groups)
        component = materialise(connected_components(_linked(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), texts, component)), "similar-components")
    named = prints.join(component, prints["f"] == component["node"], "left").select("f", "first_id", F.coalesce("component", "f").alias("component"))
    named = materialise(named, "similar-named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows.select("id", "h", "f"), named.join(least, "component").select("f", "component", "component_id")
