"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample: the exact neighbour graph of the sample, a
balanced partitioning of that graph, and a small classifier that learns to
tell a vector's partition. The number of partitions a query visits is the
smallest that reaches ``TARGET`` recall on vectors kept from the fitting.

A table of more than ``MAX_PARTITIONS`` partitions' worth of vectors has two
levels: the rows of each partition are partitioned again, by a classifier of
their own that a task fits on a bounded sample of them, and a query visits the
most probable inner partitions of each outer one it is routed to. So partitions
keep their size up to ``MAX_PARTITIONS`` squared of them; the levels share the
recall target between them.

Searching: the classifiers put every vector into one partition and route each
query to its most probable ones. Partitions are dealt in blocks of rows and
queries in blocks of queries, both of bounded size, so a partition that holds a
third of all vectors is many tasks. Each task scores its block and keeps k
candidates a query; the best k over all blocks are ranked again.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id or with another dimension
than most rows have; of rows that repeat an id, the smallest vector asks and
each answers, once, with its best score; fewer candidates than k are all
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.workspace import broadcast_object, materialise

#: Bounds of the sample that is fitted: vectors, and numbers in them.
SAMPLE_ROWS, SAMPLE_VALUES = 8192, 4_000_000
ROWS_PER_PARTITION = 4096
#: Partitions of one level, at least and at most; of a sample too small for that, one for every 24 vectors.
MIN_PARTITIONS, MAX_PARTITIONS = 4, 256
TARGET = 0.97
BLOCK_VALUES = 1 << 20
GRAPH_DEGREE = 10


@dataclass
class Router:
    """Softmax over partitions: one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of each row's nearest other rows by inner product."""
    degree = min(degree, len(x) - 1)
    out = np.zeros((len(x), degree), dtype=np.int64)
    for at in range(0, len(x), 512):
        score = x[at : at + 512] @ x.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        out[at : at + 512] = np.argpartition(-score, degree - 1, axis=1)[:, :degree]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 0.1) -> np.ndarray:
    """Parts of nearly equal size that cut few edges of the graph.

    The start splits recursively at the middle of the main axis; then nodes move
    to the part that most of their neighbours are in, while it has room.
    """
    label = np.zeros(len(x), dtype=np.int64)

    def split(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            label[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        axis = rng.standard_normal(x.shape[1])
        for _ in range(12):
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) + 1e-30
        order = rows[np.argsort(centred @ axis, kind="stable")]
        half = count // 2
        cut = len(rows) * half // count
        split(order[:cut], first, half)
        split(order[cut:], first + half, count - half)

    split(np.arange(len(x)), 0, parts)
    room = int(np.ceil(len(x) / parts * (1 + slack)))
    size = np.bincount(label, minlength=parts)
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    ends = np.concatenate([source, graph.ravel()])
    others = np.concatenate([graph.ravel(), source])[np.argsort(ends, kind="stable")]
    offset = np.concatenate(([0], np.cumsum(np.bincount(ends, minlength=len(x)))))
    for _ in range(6):
        moves = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[others[offset[i] : offset[i + 1]]], minlength=parts)
            own = label[i]
            votes[size >= room] = -1
            best = int(votes.argmax())
            if best != own and votes[best] > max(0, np.count_nonzero(label[others[offset[i] : offset[i + 1]]] == own)):
                label[i] = best
                size[own] -= 1
                size[best] += 1
                moves += 1
        if moves < len(x) // 200:
            break
    return label


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 64, epochs: int = 40) -> Router:
    """target: for every row the share of its neighbourhood in each partition."""
    scale = float(1 / (x.std() + 1e-12))
    dim, parts = x.shape[1], target.shape[1]
    p = [rng.standard_normal((dim, hidden)) / np.sqrt(dim), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            inp = x[rows] * scale
            mid = np.maximum(inp @ p[0] + p[1], 0)
            z = mid @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dm = (dz @ p[2].T) * (mid > 0)
            grads = [inp.T @ dm, dm.sum(axis=0), mid.T @ dz, dz.sum(axis=0)]
            step += 1
            rate = 0.004 * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p, scale, 1)


def fit_router(x: np.ndarray, n_rows: int, k: int, seed: int = 7, target: float | None = None) -> Router:
    """A router for a table of ``n_rows`` vectors from a sample of them."""
    dim, goal = x.shape[1], TARGET if target is None else target
    parts = int(min(MAX_PARTITIONS, max(MIN_PARTITIONS, round(n_rows / ROWS_PER_PARTITION)), max(1, len(x) // 24)))
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0, 1)
    rng = np.random.default_rng(seed)
    kept = rng.random(len(x)) < min(0.2, 1000 / len(x))  # asked for the calibration, not fitted
    base, asked = x[~kept], x[kept]
    graph = neighbour_graph(base, GRAPH_DEGREE)
    label = balanced_partition(base, graph, parts, rng)
    target = np.full((len(base), parts), 0.0)
    np.add.at(target, (np.repeat(np.arange(len(base)), graph.shape[1]), label[graph.ravel()]), 1.0 / graph.shape[1])
    target = 0.5 * target
    target[np.arange(len(base)), label] += 0.5
    router = train_router(base, target, rng)
    router.probes = parts
    if len(asked):
        home = router.nearest(base, 1)[:, 0]
        score = asked @ base.T
        k = min(k, len(base))
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        rank = np.argsort(np.argsort(-router.logits(asked), axis=1, kind="stable"), axis=1)
        reached = np.take_along_axis(rank, home[best], axis=1)
        for probes in range(1, parts + 1):
            if (reached < probes).mean() >= goal:
                router.probes = probes
                break
    return router


@dataclass
class Cells:
    """An outer router and, in tables of two levels, the routers inside its partitions."""

    outer: Router
    inner: dict[int, Router]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The partition of each vector."""
        part = self.outer.nearest(x, 1)[:, 0]
        cell = part * MAX_PARTITIONS
        for one, router in self.inner.items():
            mine = part == one
            if mine.any():
                cell[mine] += router.nearest(x[mine], 1)[:, 0]
        return cell.astype(np.int32)

    def near(self, x: np.ndarray) -> list[list[int]]:
        """The partitions that each vector asks."""
        parts = self.outer.nearest(x, self.outer.probes)
        out: list[list[int]] = [[] for _ in x]
        for one in np.unique(parts).tolist():
            mine = np.flatnonzero((parts == one).any(axis=1))
            router = self.inner.get(one)
            inside = router.nearest(x[mine], router.probes) if router else np.zeros((len(mine), 1), dtype=int)
            for i, row in zip(mine.tolist(), (inside + one * MAX_PARTITIONS).tolist(), strict=True):
                out[i] += row
        return out


INDEX = "id long, cell int, x array<double>"


def _placing(shared: Callable[[], Cells], dim: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
                yield pa.record_batch([batch.column(0), pa.array(own.of(x)), batch.column(1).cast(pa.list_(pa.float64()))], names=["id", "cell", "x"])

    return place


def _fit_inner(outer: DataFrame, wanted: int, k: int, seed: int, target: float) -> dict[int, Router]:
    """A router for each outer partition, each fitted by a task on about ``wanted`` of its vectors.

    There are at most ``MAX_PARTITIONS`` of them, each of a hidden layer's size.
    """
    sizes = {r["cell"]: r["count"] for r in outer.groupBy("cell").count().collect()}
    share = F.create_map(*[F.lit(v) for cell, n in sizes.items() for v in (cell, int(min(1.0, wanted / n) * (1 << 30)))])
    drawn = outer.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) < share[F.col("cell")])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        # Rows that repeat one id are drawn together; the bound holds for them too.
        found = fit_router(np.stack(pdf["x"].iloc[: 2 * wanted].to_numpy()), sizes[cell], k, seed, target)
        return pd.DataFrame({"cell": [cell], "router": [pickle.dumps(tuple(vars(found).values()))]})

    fitted = drawn.groupBy("cell").applyInPandas(fit, "cell int, router binary").collect()
    return {r["cell"] // MAX_PARTITIONS: Router(*pickle.loads(bytes(r["router"]))) for r in fitted}


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda c: c != 0)


def search(
    table: DataFrame, query_every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``query_every``."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(_usable(F.col("x")), F.lit(False)))
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim, n_rows = sizes["dim"], sizes["count"]
    rows = rows.where(F.size("x") == dim)
    wanted = min(SAMPLE_ROWS, max(64, SAMPLE_VALUES // dim))
    levels = 1 if n_rows <= MAX_PARTITIONS * ROWS_PER_PARTITION else 2
    target = TARGET ** (1 / levels)
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    sample = rows.where(draw < int(min(1.0, wanted / n_rows) * (1 << 30))).select("x").limit(2 * wanted).toPandas()["x"]
    sample = np.array(sample.tolist(), dtype=np.float64).reshape(-1, dim)
    router = fit_router(sample, n_rows, k, seed, target) if len(sample) else fit_router(np.ones((1, dim)), 1, k, seed)
    inner: dict[int, Router] = {}
    if levels == 2:
        outer = materialise(rows.mapInArrow(_placing(broadcast_object(spark, Cells(router, {})), dim), INDEX), "ann-outer")
        inner = _fit_inner(outer, wanted, k, seed, target)
    shared = broadcast_object(spark, Cells(router, inner))
    index = materialise(rows.mapInArrow(_placing(shared, dim), INDEX), "ann-index")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
                cells = pa.array(own.near(x), pa.list_(pa.int32()))
                yield pa.record_batch([batch.column(0), cells, batch.column(1).cast(pa.list_(pa.float64()))], names=["id", "cells", "x"])

    asking = rows.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min("x").alias("x"))
    asked = materialise(
        asking.mapInArrow(route, "id long, cells array<int>, x array<double>").select("id", "x", F.explode("cells").alias("cell")), "ann-queries"
    )
    block = max(256, BLOCK_VALUES // dim)
    count = F.ceil(F.count(F.lit(1)) / block).cast("int")
    # One row a partition that holds rows and is asked: MAX_PARTITIONS squared at most.
    blocks = index.groupBy("cell").agg(count.alias("row_blocks")).join(asked.groupBy("cell").agg(count.alias("query_blocks")), "cell")
    blocks = F.broadcast(materialise(blocks, "ann-blocks"))

    def dealt(frame: DataFrame, own: str, other: str) -> DataFrame:
        """A row goes to its own block, together with each block of the other side."""
        each = frame.join(blocks, "cell").withColumn(own[:1] + "b", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        each = each.withColumn(other[:1] + "b", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return each.select("cell", "rb", "qb", "id", "x")

    left, right = dealt(index, "row_blocks", "query_blocks"), dealt(asked, "query_blocks", "row_blocks")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, asks = a["id"].to_numpy(), b["id"].to_numpy()
        if not len(ids) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, y = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
        out = []
        for at in range(0, len(asks), 256):
            own = asks[at : at + 256]
            rough = y[at : at + 256] @ x.T
            rough[own[:, None] == ids[None, :]] = -np.inf
            for q in range(len(own)):
                out.append(_best(own[q], y[at + q], rough[q], ids, x, k))
        return pd.DataFrame(np.concatenate(out)) if out else None

    found = left.groupBy("cell", "rb", "qb").cogroup(right.groupBy("cell", "rb", "qb")).applyInPandas(score, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = np.dtype([("query_id", np.int64), ("vec_id", np.int64), ("score", np.float64)])


def _best(query_id: int, query: np.ndarray, rough: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k best rows of a block, scored one by one so that equal vectors tie exactly."""
    able = np.isfinite(rough).sum()
    if not able:
        return np.zeros(0, FOUND)
    kth = np.partition(rough, len(rough) - min(k, able))[len(rough) - min(k, able)]
    near = np.flatnonzero(rough >= kth - 1e-9 * max(1.0, abs(kth)))
    exact = (x[near] * query).sum(axis=1)
    order = np.lexsort((ids[near], -exact))
    names, first = np.unique(ids[near][order], return_index=True)  # a repeated id answers once
    picked = near[order[np.sort(first)]]
    scores = exact[order[np.sort(first)]]
    if len(picked) < min(k, able) and len(names) < len(near):  # repeats took places: look at all rows
        exact = np.where(np.isfinite(rough), (x * query).sum(axis=1), -np.inf)
        order = np.lexsort((ids, -exact))[:able]
        _, first = np.unique(ids[order], return_index=True)
        picked, scores = order[np.sort(first)], exact[order[np.sort(first)]]
    out = np.zeros(min(k, len(picked)), FOUND)
    out["query_id"], out["vec_id"], out["score"] = query_id, ids[picked[: len(out)]], scores[: len(out)]
    return out


def op8_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_every=20, k=20)
