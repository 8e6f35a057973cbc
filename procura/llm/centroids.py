"""Centroid clustering in whole numbers, by ball-tree filtering.

Each partition of the input is cut into blocks of vectors, and each block into a tree
of balls; a ball stores its radius, count and integer sum. The trees are written once.
In a round every block filters the centroids down its tree: by the triangle inequality a
centroid farther from a ball's centre than the nearest one by more than twice the radius
takes none of its vectors. A ball left with one centroid goes to it whole, by its sum
and count; any other descends, to exact distances at the leaves. Sums and counts
of a task are combined before they are shuffled, so each round moves (centroids x
components) numbers a task, and that many reach the driver.

Distances, sums and means are exact: floating point below 2**53, else whole numbers
of any length. A distance that doesn't fit in 64 bits is an error.

Defined results: vectors that are null, have another number of components or a null or
non-finite one are left out; a null id stays, and is the last choice as a first centroid;
repeated rows and ids are rows of their own; with fewer vectors than centroids there are
fewer centroids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.workspace import broadcast_object, materialise

N_CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256.0, 2
#: Numbers in the vectors of one block, which one task holds; vectors of a leaf.
BLOCK_VALUES, LEAF = 1 << 18, 24
#: Up to this size of a component, squared distances of 64 components stay below 2**53.
EXACT = float(1 << 22)


@dataclass
class Tree:
    """A complete binary tree: the balls of node i are nodes 2i + 1 and 2i + 2; a node's vectors are rows first to last."""

    x: np.ndarray
    first: np.ndarray
    last: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @property
    def leaves_from(self) -> int:
        return len(self.first) // 2


def grow(x: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of a block, and the order of its rows in it. Balls are halved across their widest direction."""
    depth = max(0, int(np.ceil(np.log2(max(len(x), 1) / LEAF))))
    n = (1 << (depth + 1)) - 1
    order = np.arange(len(x))
    first, last = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    radius, total = np.zeros(n), np.zeros((n, x.shape[1]), dtype=x.dtype)
    last[0] = len(x)
    for node in range(n):
        a, b = int(first[node]), int(last[node])
        own = x[order[a:b]]
        total[node] = own.sum(axis=0)
        centre = total[node].astype(float) / max(b - a, 1)
        away = own.astype(float) - centre
        norms = np.sqrt((away * away).sum(axis=1))
        radius[node] = norms.max(initial=0.0)
        if node < n // 2:
            axis = away[int(norms.argmax())]
            for _ in range(2):
                axis = away.T @ (away @ axis)
                axis /= np.abs(axis).max() + 1e-300
            order[a:b] = order[a:b][np.argsort(away @ axis, kind="stable")]
            half = (a + b) // 2
            first[2 * node + 1], last[2 * node + 1], first[2 * node + 2], last[2 * node + 2] = a, half, half, b
    return Tree(x[order], first, last, radius, total), order


def squared(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of z."""
    if x.dtype == object or z.dtype == object:
        return np.stack([((x - row) ** 2).sum(axis=1) for row in z], axis=1)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ z.T) + (z * z).sum(axis=1)


def filtered(tree: Tree, z: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(centroid of each row, balls that went whole with their centroid, rows judged at leaves, their distances)."""
    zf = z.astype(float)
    label = np.full(len(tree.x), -1, dtype=np.int64)
    whole: list[tuple[int, int]] = []
    rows, masks = [], []
    nodes, alive = np.zeros(1, dtype=np.int64), np.ones((1, len(z)), dtype=bool)
    while len(nodes):
        count = np.maximum(tree.last[nodes] - tree.first[nodes], 1)
        centre = tree.total[nodes].astype(float) / count[:, None]
        size = np.maximum((centre * centre).sum(axis=1)[:, None], (zf * zf).sum(axis=1))
        d = np.sqrt(np.maximum(squared(centre, zf), 0.0))
        d[~alive] = np.inf
        # The slack is far above what rounding can do to a distance.
        reach = d.min(axis=1) + 2 * tree.radius[nodes]
        alive = d <= reach[:, None] * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(size))
        alone = alive.sum(axis=1) == 1
        for node, to in zip(nodes[alone].tolist(), alive[alone].argmax(axis=1).tolist(), strict=True):
            whole.append((node, to))
            label[tree.first[node] : tree.last[node]] = to
        nodes, alive = nodes[~alone], alive[~alone]
        at_leaf = nodes >= tree.leaves_from
        for node, mask in zip(nodes[at_leaf].tolist(), alive[at_leaf], strict=True):
            rows.append(np.arange(tree.first[node], tree.last[node]))
            masks.append(np.broadcast_to(mask, (len(rows[-1]), len(z))))
        nodes, alive = nodes[~at_leaf], alive[~at_leaf]
        nodes, alive = np.concatenate([2 * nodes + 1, 2 * nodes + 2]), np.concatenate([alive, alive])
    if not rows:
        return label, whole, np.zeros(0, dtype=np.int64), np.zeros(0)
    at = np.concatenate(rows)
    d2 = squared(tree.x[at], z)
    d2[~np.concatenate(masks)] = np.inf
    label[at] = d2.argmin(axis=1)  # of equals the smallest number
    return label, whole, at, d2[np.arange(len(at)), label[at]]


# --- blocks as rows ---------------------------------------------------------


def _whole_numbers(values: np.ndarray) -> np.ndarray:
    """Doubles that are whole, as they are where arithmetic on them is exact, else as numbers of any length."""
    return values if np.abs(values).max(initial=0.0) <= EXACT else np.array([[int(v) for v in row] for row in values], dtype=object)


def _packed(x: np.ndarray) -> bytes:
    """Rows in the fewest bytes: two for each component where that holds them, else a double, which holds them all."""
    values = x.astype(np.float64)
    short = values.astype(np.int16)
    return b"s" + short.tobytes() if np.abs(values).max(initial=0.0) < 2**15 else b"d" + values.tobytes()


def _unpacked(raw: bytes, dim: int) -> np.ndarray:
    kind = np.int16 if raw[:1] == b"s" else np.float64
    return np.frombuffer(raw, dtype=kind, offset=1).astype(np.float64).reshape(-1, dim)


TREE = "ids array<long>, x binary, first binary, last binary, radius binary, total array<decimal(38,0)>"


def _trees(dim: int, scale: float):
    per_block = max(1, BLOCK_VALUES // dim)

    def row(ids: list, x: np.ndarray) -> pa.RecordBatch:
        tree, order = grow(_whole_numbers(np.floor(x * scale)))
        total = [Decimal(int(v)) for v in tree.total.ravel()]
        values = [[[ids[i] for i in order.tolist()]], [_packed(tree.x)], [tree.first.tobytes()], [tree.last.tobytes()], [tree.radius.tobytes()], [total]]
        kinds = [pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.decimal128(38, 0))]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["ids", "x", "first", "last", "radius", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []
        for batch in batches:
            at = 0
            x = np.asarray(batch["x"].flatten()).reshape(-1, dim)
            own = batch["id"].to_pylist()
            while at < len(own):
                room = per_block - len(ids)
                ids += own[at : at + room]
                parts.append(x[at : at + room])
                at += room
                if len(ids) == per_block:
                    yield row(ids, np.concatenate(parts))
                    ids, parts = [], []
        if ids:
            yield row(ids, np.concatenate(parts))

    return run


def _read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[list, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            first, last = (np.frombuffer(batch[c][i].as_py(), dtype=np.int64) for c in ("first", "last"))
            total = np.array([float(v) if abs(v) < 2**53 else int(v) for v in batch["total"][i].as_py()], dtype=object)
            x = _whole_numbers(_unpacked(batch["x"][i].as_py(), dim))
            if x.dtype != object:
                total = total.astype(float)
            yield batch["ids"][i].as_py(), Tree(x, first, last, np.frombuffer(batch["radius"][i].as_py(), dtype=np.float64), total.reshape(-1, dim))


def _sums(centroids, dim: int):
    """A task's counts and sums: one row for each centroid and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _whole_numbers(np.array(centroids(), dtype=np.float64))
        count, total = np.zeros(len(z), dtype=np.int64), np.zeros((len(z), dim), dtype=object)
        for _, tree in _read(batches, dim):
            label, whole, at, _ = filtered(tree, z)
            count += np.bincount(label, minlength=len(z))
            for node, to in whole:
                total[to] += [int(v) for v in tree.total[node]]
            if len(at):
                for to in np.unique(label[at]).tolist():
                    own = tree.x[at[label[at] == to]].sum(axis=0)
                    total[to] += [int(v) for v in own]
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(used, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(used)), pa.int32()),
                    pa.array([Decimal(v) for v in total[used].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(count[used], dim), pa.int64()),
                ],
                names=["cluster", "component", "total", "n"],
            )

    return run


def _assigned(centroids, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _whole_numbers(np.array(centroids(), dtype=np.float64))
        for ids, tree in _read(batches, dim):
            label, whole, at, d2 = filtered(tree, z)
            distance = np.zeros(len(ids), dtype=object)
            distance[at] = d2
            for node, to in whole:
                a, b = tree.first[node], tree.last[node]
                distance[a:b] = squared(tree.x[a:b], z[to : to + 1])[:, 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array([int(v) for v in distance], pa.int64())], names=["id", "cluster", "distance"]
            )

    return run


# --- the operator -----------------------------------------------------------


def _kept(vectors: DataFrame, dim: int, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col).cast("array<double>")
    wrong = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where((F.size(x) == dim) & ~wrong).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def first_centroids(kept: DataFrame, k: int, scale: float, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id; of equals, the smaller vector first."""
    place: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(place.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return [[int(v) for v in np.floor(np.array(r["x"]) * scale)] for r in rows]


def cluster(
    vectors: DataFrame, k: int = N_CLUSTERS, rounds: int = ROUNDS, dim: int = COMPONENTS, scale: float = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of each vector, and the final centroids (k x dim numbers, the only state in the driver)."""
    spark = vectors.sparkSession
    kept = _kept(vectors, dim, id_col, vec_col)
    z = first_centroids(kept, k, scale, seed)
    if not z:
        return spark.createDataFrame([], "id long, cluster int, distance long"), z
    trees = materialise(kept.mapInArrow(_trees(dim, scale), TREE), "ball-trees")
    for _ in range(rounds):
        moved = trees.mapInArrow(_sums(broadcast_object(spark, z), dim), "cluster int, component int, total decimal(38,0), n long")
        for r in moved.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            z[r["cluster"]][r["component"]] = int(r["total"]) // r["n"]
    return materialise(trees.mapInArrow(_assigned(broadcast_object(spark, z), dim), "id long, cluster int, distance long"), "clusters"), z


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster and distance after five rounds, with the clusters' inertia."""
    found, z = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    names = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(z)]
    of = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.withColumnRenamed("id", "vec_id").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql() -> str:
    """Rounds as common tables: zN holds the centroids before round N as (cluster, component, v)."""
    nearest = """a{n} AS MATERIALIZED (
    SELECT row, vec_id, min_by(cluster, d * 1000 + cluster)::INT AS cluster, min(d)::BIGINT AS distance
    FROM (SELECT x.row, x.vec_id, z.cluster, sum((x.v - z.v) * (x.v - z.v)) AS d FROM x JOIN z{n} AS z USING (component) GROUP BY ALL) GROUP BY row, vec_id)"""
    moved = """z{m} AS MATERIALIZED (
    SELECT z.cluster, z.component, coalesce(u.v, z.v) AS v FROM z{n} AS z LEFT JOIN (
        SELECT a.cluster, x.component, ((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
        FROM a{n} AS a JOIN x ON x.row = a.row GROUP BY ALL) AS u USING (cluster, component))"""
    steps = [s for n in range(ROUNDS) for s in (nearest.format(n=n), moved.format(n=n, m=n + 1))]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS xs FROM embeddings
    WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS MATERIALIZED (SELECT row, vec_id, unnest(range({COMPONENTS})) AS component, unnest(xs) AS v FROM kept),
z0 AS MATERIALIZED (
    SELECT cluster, unnest(range({COMPONENTS})) AS component, unnest(xs) AS v
    FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster, xs FROM kept) WHERE cluster < {N_CLUSTERS}
), {", ".join(steps)}, {nearest.format(n=ROUNDS)},
names AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY component)) AS centroid_sha256 FROM z{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN names USING (cluster)
"""


OP11_SQL = _op11_sql()
