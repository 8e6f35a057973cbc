"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a share of all words by its weight, at most ``max_epochs``
times its own words. A document enters floor(target / size) times for certain
and once more with the fractional rest as inclusion probability. The flight
phase moves those probabilities through the null space of two balancing
constraints, words and documents, block by block, until at most two units of a
block are undecided. These leftovers and a dozen units that wait meet again in
later rounds. When a source has come down to one block, the landing phase
decides the last units, fourteen at most, by the subset nearest to both totals. Where
that still misses the source's target by more than ``NEAR`` of it, taken units of that last block are exchanged
for others of it, in pairs, until it is near or no exchange helps: there inclusion
probabilities hold only nearly. All other units keep theirs exactly.

Defined results: a null text or one without words has size 0 and is taken with
0 words; a null source is a source of its own and sorts last; sources without a
word have target 0; rows with equal id, size and source are interchangeable;
an empty table gives an empty result. Choices depend on hashes of the rows and
on the seed only, so reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.operators.numbering import numbered
from procura.workspace import materialise

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_ROWS = 4096
EPS = 1e-9
#: Units of a block that wait for the landing.
LANDING = 12
#: Swaps after the landing end when the words are this near to their target, as a share of it.
NEAR = 2e-5


def row_hash(doc_id: Column, text: Column, source: Column) -> Column:
    """With the id, this names a row in the results of ``mix``. A hash alone would pass over nulls."""
    return F.xxhash64(doc_id, text, source, text.isNull(), source.isNull())


def source_targets(sized: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """(source, source_size, n_docs, target), one row a source.

    Weights repeat over the sources in code point order, null last. The share
    above ``max_epochs`` times a source's size goes to the others by weight,
    again until none is above.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    totals = numbered(totals, [F.col("source").asc_nulls_last()], "place").withColumn("w", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    totals = materialise(totals.drop("place"), "mix-sources")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    everything = totals.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        full = F.col("w") * F.lit(level) >= cap
        row = totals.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == before or not row["open"]:
            break
        before, level = row["n"], (everything - row["used"]) / row["open"]
    return totals.select(
        "source", "source_size", "n_docs", F.least(F.col("w") * F.lit(level), cap).cast("double").alias("target")
    )


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities until at most two of them are strictly between 0 and 1.

    Each step takes three undecided units, a direction u with sum(u) = 0 and
    sum(u * size) = 0, and walks to one of its two ends with the chances that
    keep every expectation. Two units of equal size need no third.
    """
    out = prob.tolist()
    sizes = size.tolist()
    draws = iter(rng.random(len(out) + 4).tolist())
    held: list[int] = []
    for unit in range(len(out)):
        if not EPS < out[unit] < 1 - EPS:
            continue
        held.append(unit)
        while True:
            step = _direction(held, sizes)
            if step is None:
                break
            up = min((1 - out[i]) / u if u > 0 else out[i] / -u for i, u in step)
            down = min(out[i] / u if u > 0 else (1 - out[i]) / -u for i, u in step)
            go = up if next(draws, 0.5) * (up + down) < down else -down
            for i, u in step:
                moved = out[i] + go * u
                out[i] = 0.0 if moved < EPS else 1.0 if moved > 1 - EPS else moved
            held = [i for i in held if 0.0 < out[i] < 1.0]
    return np.array(out)


def _direction(held: list[int], sizes: list[float]) -> list[tuple[int, float]] | None:
    """u with sum(u) = 0 and sum(u * size) = 0, on two units of equal size or on three."""
    for i, a in enumerate(held):
        for b in held[i + 1 :]:
            if sizes[a] == sizes[b]:
                return [(a, 1.0), (b, -1.0)]
    if len(held) < 3:
        return None
    a, b, c = held[:3]
    move = ((a, sizes[b] - sizes[c]), (b, sizes[c] - sizes[a]), (c, sizes[a] - sizes[b]))
    scale = max(abs(u) for _, u in move)
    return [(i, u / scale) for i, u in move if u]


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of all ways to decide the few units left, the one nearest to both totals, words first.

    At most ``LANDING`` units and two: all subsets are tried.
    """
    out = prob.copy()
    open_ = np.flatnonzero((out > 0) & (out < 1))
    if len(open_):
        ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        off = ways - out[open_]
        cost = np.abs(off @ size[open_]) / max(1.0, size.mean()) + 0.05 * np.abs(off.sum(axis=1))
        out[open_] = ways[cost.argmin()]
    return out


def swap(prob: np.ndarray, out: np.ndarray, size: np.ndarray, goal: float) -> np.ndarray:
    """Exchange taken units for others, one pair at a time, while that brings the words nearer to their total.

    ``prob`` are the probabilities before the block was decided; ``goal`` is the source's target,
    the measure of near. The number of taken units stays.
    """
    out = out.copy()
    free = (prob > EPS) & (prob < 1 - EPS)
    off = float(((out - prob) * size).sum())
    for _ in range(len(prob)):
        if abs(off) <= NEAR * goal:
            break
        taken, left = np.flatnonzero(free & (out == 1.0)), np.flatnonzero(free & (out == 0.0))
        if not len(taken) or not len(left):
            break
        left = left[np.argsort(size[left], kind="stable")]
        # For every taken unit the other unit whose size comes nearest to taking up the difference.
        wish = size[taken] - off
        at = np.searchsorted(size[left], wish)
        near = np.stack([np.clip(at - 1, 0, len(left) - 1), np.clip(at, 0, len(left) - 1)])
        after = np.abs(off - size[taken] + size[left][near])
        way, which = np.unravel_index(after.argmin(), after.shape)
        if after[way, which] >= abs(off) - EPS:
            break
        gone, come = taken[which], left[near[way, which]]
        out[gone], out[come] = 0.0, 1.0
        off += float(size[come] - size[gone])
    return out


def decide(prob: np.ndarray, size: np.ndarray, last: bool, rng: np.random.Generator, goal: float = 0.0) -> np.ndarray:
    """One block's flight and, in a source's last block, its landing and swaps.

    The units come in random order. The first ``LANDING`` wait: subsets of them make
    up for what the flight leaves undecided, which may be large.
    """
    waits = np.arange(len(prob)) < LANDING
    flying = np.flatnonzero(~waits)
    # Large units first; next to its equals a large unit would hardly move, so
    # the order within a power of two stays random.
    flying = flying[np.argsort(-np.floor(np.log2(size[flying] + 1.0)), kind="stable")]
    out = prob.copy()
    out[flying] = flight(out[flying], size[flying], rng)
    return swap(prob, land(out, size), size, goal) if last else out


def _decide(seed: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "size", "id", "copy"], kind="stable").reset_index(drop=True)
        name = zlib.crc32(repr(pdf["source"][0]).encode())
        rng = np.random.default_rng([seed, name, int(pdf["round"][0]), int(pdf["block"][0]), len(pdf)])
        prob, size = pdf["prob"].to_numpy(dtype="float64"), pdf["size"].to_numpy(dtype="float64")
        return pdf.assign(prob=decide(prob, size, bool(pdf["blocks"][0] == 1), rng, float(pdf["target"][0])))

    return block


def _numbered(sized: DataFrame) -> DataFrame:
    """The rows with a number ``copy`` that tells equal rows apart, whichever task reads them.

    Equal rows are counted and written out again, at most ``BLOCK_ROWS`` of them in one piece.
    """
    last = F.col("n") - 1
    pieces = sized.groupBy("id", "source", "h", "size").agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK_ROWS)))).repartition("h", "piece")
    first = F.col("piece") * BLOCK_ROWS
    return pieces.withColumn("copy", F.explode(F.sequence(first, F.least(first + (BLOCK_ROWS - 1), last)))).drop("n", "piece")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
    seed: int = 17,
) -> DataFrame:
    """(id, source, h, size, source_size, target, copies): how often the mix takes each document.

    ``h`` is a hash of id, text and source: with it the decision finds its row again.
    """
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        row_hash(F.col(id_col), text, F.col(source_col)).alias("h"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = materialise(_numbered(sized), "mix-sizes")
    targets = source_targets(sized, weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(ratio + EPS)
    rest = F.greatest(ratio - base, F.lit(0.0))
    rows = (
        sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("base", base.cast("int"))
        .withColumn("prob", F.when(rest > EPS, rest).otherwise(0.0))
    )
    undecided = (F.col("prob") > 0) & (F.col("prob") < 1)
    parts = [rows.where(~undecided).drop("n_docs")]
    pending = rows.where(undecided).withColumn("n", F.col("n_docs")).drop("n_docs")
    kept = ["id", "source", "h", "copy", "size", "source_size", "target", "base", "prob"]
    for round_ in range(12):
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).cast("long")
        dealt = (
            pending.withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("h", "copy", F.lit(round_)), F.col("blocks")))
            .withColumn("round", F.lit(round_))
            .select(*kept, "blocks", "block", "round")
        )
        done = materialise(
            dealt.groupBy("source", "block").applyInPandas(_decide(seed), dealt.schema), f"mix-round{round_}"
        )
        parts.append(done.where(~undecided).select(*kept))
        left = done.where(undecided)
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s")
        if counts.isEmpty():
            break
        pending = left.join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    else:
        raise RuntimeError("the flight phase did not end")
    out = parts[0].select(*kept)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("copies", (F.col("base") + F.round("prob")).cast("int")).drop("base", "prob", "copy")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
