"""SimHash fingerprints linked by covering locality-sensitive hashing.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 hashes
(seed 42) of a text's word shingles.

Links: bit positions carry 5-bit codes, and table v (1 to 31) keeps the
positions whose code has an odd inner product with v. Four differing positions
span at most four dimensions of the code space, so some v is orthogonal to all
of them: every pair within four bits collides in some table. A bucket of more
than ``BUCKET`` distinct fingerprints is split by the same construction over
the positions its mask left free. Each level halves those, 64 to at most 32,
16 and 8, so after three levels a bucket holds at most 2**8 fingerprints: no
bucket needs a cap. Within a bucket only a spanning forest is emitted, not all
pairs.

Defined results: a text without words, null included, has fingerprint zero and
is linked like any other; one with fewer words than a shingle has one shingle;
repeated rows share a component; a null id takes part in linking but never
names a component unless no other id can, then the name is null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procura.operators.components import connected_components
from procura.workspace import materialise

SEED = 42
RADIUS = 4
TABLES = range(1, 2 ** (RADIUS + 1))
BUCKET = 256


# --- fingerprints ---------------------------------------------------------


def shingle_digests(raw: bytes, words_per_shingle: int) -> list[bytes]:
    """XXH64 digests of the word shingles of a UTF-8 text, repeats included."""
    words = raw.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return [xxhash.xxh64_digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(words) - words_per_shingle + 1].tolist(), ends[words_per_shingle - 1 :].tolist(), strict=True)
    return [digest(joined[a:b], SEED) for a, b in spans]


#: Where each of eight bytes is counted, and the bits of every byte.
BYTE_PLACE = (np.arange(8) * 256).astype(np.int64)
BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def majority(digests: list[bytes], byte_place: np.ndarray = BYTE_PLACE, bit_of: np.ndarray = BIT_OF) -> int:
    """The fingerprint of a text's shingle digests, as a signed number."""
    if not digests:
        return 0
    seen = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8) + byte_place
    counts = np.bincount(seen.ravel(), minlength=8 * 256).reshape(8, 256) @ bit_of
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(digests)).tobytes(), "big", signed=True)


def fingerprint(text: Column, words_per_shingle: int = 4) -> Column:
    """The fingerprint as a long, of a string column."""
    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([majority(shingle_digests(x, words_per_shingle) if x else []) for x in part], dtype="int64")

    return F.pandas_udf(batches, T.LongType())(text.cast("binary"))


# --- covering masks -------------------------------------------------------


def _codes(positions: int, level: int) -> list[int]:
    """A non-zero 5-bit code for each free position; the last level's all have the top bit."""
    if level == 3:
        return [16 + i for i in range(positions)]
    return [1 + i % 31 for i in range(positions)]


def covering_masks(kept: int = 0, level: int = 1) -> list[int]:
    """31 masks that add positions to those in ``kept``."""
    free = [i for i in range(64) if not kept >> i & 1]
    codes = _codes(len(free), level)
    out = []
    for v in TABLES:
        mask = kept
        for place, code in zip(free, codes, strict=True):
            mask |= ((code & v).bit_count() & 1) << place
        out.append(mask)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first_tables(prints: DataFrame) -> DataFrame:
    """(path, key, f): every fingerprint in each of the 31 tables."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks()])
    return prints.select("f", F.posexplode(masks).alias("path", "mask")).select(
        (F.col("path") + 1).cast("long").alias("path"), F.col("f").bitwiseAND(F.col("mask")).alias("key"), "f"
    )


def _next_tables(members: DataFrame, level: int) -> DataFrame:
    """The members of large buckets in the tables of the next level."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}

        def of(path: int) -> np.ndarray:
            if path not in masks:
                steps, kept = [], 0
                while path:
                    steps.append(path % 32)
                    path //= 32
                for depth, v in enumerate(reversed(steps), 1):
                    kept = covering_masks(kept, depth)[v - 1]
                return np.array(covering_masks(kept, level), dtype=np.uint64)
            return masks[path]

        for batch in batches:
            path, f = (np.asarray(batch.column(i)) for i in (0, 1))
            for one in np.unique(path):
                masks.setdefault(int(one), of(int(one)))
                mine = f[path == one]
                prints = np.tile(mine, len(TABLES))
                table = np.repeat(np.arange(1, len(TABLES) + 1, dtype=np.int64), len(mine))
                keys = prints.view(np.uint64) & np.repeat(masks[int(one)], len(mine))
                yield pa.record_batch([one * 32 + table, keys.view(np.int64), prints], names=["path", "key", "f"])

    return members.select("path", "f").mapInArrow(expand, "path long, key long, f long")


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is within the radius, one fewer than each group has members."""
    bits = prints.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS
    todo, edges = np.ones(len(prints), dtype=bool), []
    while todo.any():
        front = [int(np.flatnonzero(todo)[0])]
        todo[front[0]] = False
        while front:
            at = front.pop()
            found = np.flatnonzero(near[at] & todo)
            todo[found] = False
            edges += [(int(prints[at]), int(prints[j])) for j in found]
            front += found.tolist()
    return edges


def _bucket_edges(lists: DataFrame) -> DataFrame:
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, ends = np.asarray(column.values), np.asarray(column.offsets)
            found = [e for a, b in zip(ends[:-1], ends[1:], strict=True) for e in _forest(values[a:b])]
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch([pairs[:, 0], pairs[:, 1]], names=["a", "b"])

    return lists.mapInArrow(edges, "a long, b long")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``f`` that connect all within the radius."""
    out = None
    tables = _first_tables(prints)
    for level in (1, 2, 3):
        buckets = materialise(
            tables.groupBy("path", "key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi"))
            .where("n > 1"),
            f"simhash-buckets{level}",
        )
        pairs = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= RADIUS))
        small = buckets.where(F.col("n").between(3, BUCKET)).select("path", "key")
        listed = tables.join(small, ["path", "key"], "left_semi").groupBy("path", "key").agg(F.collect_list("f").alias("fs"))
        found = pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(_bucket_edges(listed.select("fs")))
        out = found if out is None else out.unionByName(found)
        large = buckets.where(F.col("n") > BUCKET).select("path", "key")
        if large.isEmpty():
            break
        members = materialise(tables.join(large, ["path", "key"], "left_semi"), f"simhash-large{level}")
        tables = materialise(_next_tables(members, level + 1).distinct(), f"simhash-tables{level + 1}")
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes).

    rows: id, hash h of the text and fingerprint f of every row; classes: component,
    the smallest fingerprint linked, and component_id, the smallest id, of every f.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("h"),
            fingerprint(F.col(text_col), words_per_shingle).alias("f"),
        ),
        "simhash-prints",
    )
    prints = materialise(rows.groupBy("f").agg(F.min("id").alias("first_id")), "simhash-distinct")
    component = connected_components(links(prints.select("f")))
    named = prints.join(component, prints["f"] == component["node"], "left").select(
        "f", "first_id", F.coalesce("component", "f").alias("component")
    )
    named = materialise(named, "simhash-components")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows, named.join(least, "component").select("f", "component", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, classes = near_duplicates(docs)
    return rows.join(classes, "f").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )
