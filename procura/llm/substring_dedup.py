"""Repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes is read at every word end. A chunk
ends where that hash is smaller than at all other word ends within ``REACH``
bytes. The rule looks at nothing but the bytes nearby, so an insertion moves
the chunk ends around it and no others. Windows are the fewest adjacent chunks
of ``WINDOW_BYTES`` or more, from each chunk on and up to each chunk that ends
none of those; so the windows within a shared run of chunks cover all of it.
Windows are compared by a 64-bit digest; one that two documents share is
repeated. Repeated windows that touch, have the same first holder and follow
one another there as they do here make a passage, if they cover ``min_bytes``
or more. Passages of different first holders may overlap; a window that its
holder repeats may start a new one. Two windows at least, in step, make most
passages, so a chance agreement of two digests makes none by itself.

Windows meet once, by digest. Before that, a task looks at ``FLUSH`` windows
together: exact copies of a text are cut once and passages are handed to the
other copies through the hash of the text; of a digest that stands there more
than ``CROWD`` times only the first holder's window goes on, and the others
learn the result in a join that spreads each such digest over ``SALTS`` keys.
So a passage that a third of all documents share is a few rows of a task.

A text without white space is cut where characters of three or more UTF-8
bytes begin, and every chunk of more than ``LONGEST`` bytes is split.

Defined results: rows with a null id or null text and empty texts take no part;
rows that repeat an id with the same text count once, with another text as part
of the same document; what a document repeats within itself alone is not a
repeat; the first holder is the smallest id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.workspace import materialise

REACH = 24
LONGEST = 4096
WINDOW_BYTES = MIN_BYTES = 96
#: Windows that a task looks at together, occurrences of a digest among them that still travel one by one, and keys that share the others.
FLUSH, CROWD, SALTS = 400_000, 4, 16
#: The gear table: 16 random bits for each byte.
GEAR = np.random.default_rng(20240501).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] modulo 2**16, for all i at once.

    The sum over the last 16 bytes doubles its width in each of four steps.
    """
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h = longer
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where chunks end, the end of the data included."""
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    wide = np.zeros(n, dtype=bool)
    wide[:-1] = data[1:] >= 0xE2
    place = np.flatnonzero(space | wide)
    place = place[place < n - 1]
    if len(place):
        value = gear_hash(data)[place]
        least = np.ones(len(place), dtype=bool)
        for k in range(1, min(REACH, len(place) - 1) + 1):
            near = place[k:] - place[:-k] <= REACH
            if not near.any():
                break
            # Of equal values the first one counts as the smaller.
            right_wins = near & (value[k:] < value[:-k])
            least[:-k] &= ~right_wins
            least[k:] &= ~(near & ~right_wins)
        place = place[least]
    ends = np.concatenate((place + 1, [n]))
    if np.diff(ends, prepend=0).max() > LONGEST:
        parts, start = [], 0
        for end in ends.tolist():
            at = start + LONGEST
            while at < end:
                while at > start + 1 and data[at] & 0xC0 == 0x80:
                    at -= 1
                parts.append(at)
                start, at = at, at + LONGEST
            parts.append(end)
            start = end
        ends = np.array(parts)
    return ends


def windows(raw: bytes, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Starts, lengths, first chunks, numbers of chunks and digests of the windows of a UTF-8 text that isn't empty."""
    ends = chunk_ends(np.frombuffer(raw, dtype=np.uint8))
    edges = np.concatenate(([0], ends))
    n = len(ends)
    last = np.searchsorted(edges, edges[:-1] + min_bytes)
    first = np.arange(n)[last <= n]
    last = last[last <= n]
    ended = np.zeros(n + 1, dtype=bool)
    ended[last] = True
    bare = np.flatnonzero(~ended & (edges >= min_bytes))
    first = np.concatenate((first, np.searchsorted(edges, edges[bare] - min_bytes, side="right") - 1))
    last = np.concatenate((last, bare))
    starts, stops = edges[first], edges[last]
    digest = xxhash.xxh3_64_intdigest
    return starts, stops - starts, first, last - first, [digest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


WINDOWS = pa.schema(
    [("digest", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("many", pa.bool_()), ("crowd", pa.bool_()), ("spare", pa.bool_())]
)


def cut_windows(docs: DataFrame) -> DataFrame:
    """(digest, id, h, start, length, chunk, n, many, crowd, spare) of documents (id, h, raw).

    ``many``: two documents at least were seen to hold the window. ``spare``: a row marked ``crowd``
    stands for this one when first holders are sought.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        place: dict[int, int] = {}  # of a text among the parts
        size = 0
        for batch in batches:
            for key, h, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if h in place:
                    low, high, *rest = parts[place[h]]
                    parts[place[h]] = (min(low, key), max(high, key), *rest)
                    continue
                *places, digest = windows(raw, WINDOW_BYTES)
                place[h] = len(parts)
                parts.append((key, key, h, np.array(digest, dtype=np.uint64).view(np.int64), *places))
                size += len(digest)
                if size > FLUSH:
                    yield from _pack(parts)
                    parts, place, size = [], {}, 0
        if size:
            yield from _pack(parts)

    return docs.mapInArrow(cut, "digest long, id long, h long, start int, length int, chunk int, n int, many boolean, crowd boolean, spare boolean")


def _pack(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The windows of some texts, with a digest's crowd marked; in batches, as each is copied into the JVM whole."""
    counts = [len(p[3]) for p in parts]
    low, high, h = (np.repeat(np.array([p[i] for p in parts], dtype=np.int64), counts) for i in range(3))
    digest, *places = (np.concatenate([p[i] for p in parts]) for i in range(3, 8))
    many, crowd, spare = low != high, np.zeros(len(digest), dtype=bool), np.zeros(len(digest), dtype=bool)
    order = np.lexsort((places[0], h, low, digest))
    starts = np.flatnonzero(np.concatenate(([True], digest[order][1:] != digest[order][:-1])))
    sizes = np.diff(np.append(starts, len(order)))
    for at in np.flatnonzero(sizes > CROWD).tolist():
        own = order[starts[at] : starts[at] + sizes[at]]
        many[own[0]] = many[own].any() or low[own[0]] != low[own[-1]]
        crowd[own[0]] = spare[own[1:]] = True
    columns = [digest, low, h, *(x.astype(np.int32) for x in places), many, crowd, spare]
    for at in range(0, len(digest), 50_000):
        yield pa.record_batch([pa.array(x[at : at + 50_000]) for x in columns], schema=WINDOWS)


#: Bits of a window's place in one long: start, length, chunk (the low bits of its number) and number of chunks.
LENGTH_BITS, CHUNK_BITS, N_BITS = 13, 12, 7


def _pack_place() -> Column:
    out = F.col("start").cast("long")
    for name, bits in (("length", LENGTH_BITS), ("chunk", CHUNK_BITS), ("n", N_BITS)):
        out = F.shiftleft(out, bits).bitwiseOR(F.col(name).cast("long").bitwiseAND((1 << bits) - 1))
    return out


def _place(name: str) -> Column:
    shift = {"n": 0, "chunk": N_BITS, "length": N_BITS + CHUNK_BITS, "start": N_BITS + CHUNK_BITS + LENGTH_BITS}[name]
    bits = {"n": N_BITS, "chunk": CHUNK_BITS, "length": LENGTH_BITS, "start": 31}[name]
    return F.shiftright("place", shift).bitwiseAND((1 << bits) - 1)


def find_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES
) -> DataFrame:
    """(id, start_byte, n_bytes, n_chunks, first_id): the repeated passages of every document.

    Offsets count UTF-8 bytes; ``first_id`` is the smallest id that holds each of
    the passage's windows, and it holds the whole passage in one piece. The first
    holder is listed too, with itself as ``first_id``.
    """
    rows = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("raw")
    )
    cut = materialise(cut_windows(rows), "windows")
    met = cut.where("not spare").select("digest", "id", "h", _pack_place().alias("place"), "many", "crowd")
    same = Window.partitionBy("digest").orderBy("id", "h", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        met.withColumns({"first_id": F.first("id").over(same), "first_h": F.first("h").over(same), "first_place": F.first("place").over(same)})
        .withColumns({"last_id": F.last("id").over(same), "any_many": F.max("many").over(same)})
        .where("any_many or first_id <> last_id")
    )
    kept = ["h", "place", "first_id", "first_h", "first_place"]
    # Written once: the windows themselves and the digests whose crowds still wait.
    shared = materialise(shared.select("digest", "crowd", *kept), "shared-windows")
    spare = cut.where("spare").select("digest", "h", _pack_place().alias("place"), F.pmod("h", F.lit(SALTS)).alias("salt"))
    told = shared.where("crowd").groupBy("digest").agg(*[F.min(c).alias(c) for c in kept[2:]])
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    # Several tasks may have met the same text. Every row of a digest names the same first holder.
    once = shared.select(*kept).unionByName(spare.join(told, ["digest", "salt"]).select(*kept)).groupBy("h", "place").agg(*[F.min(c).alias(c) for c in kept[2:]])
    once = once.select("h", "first_id", "first_h", *[_place(c).alias(c) for c in ("start", "length", "chunk", "n")], "first_place")
    shift = N_BITS + CHUNK_BITS + LENGTH_BITS
    once = once.withColumn("away", F.shiftright("first_place", shift) - F.col("start"))
    order = Window.partitionBy("h").orderBy("start", "length")
    before = lambda c: F.lag(c).over(order)
    same_holder = (before("first_id") == F.col("first_id")) & (before("first_h") == F.col("first_h"))
    # In the holder itself windows follow one another; elsewhere they must lie equally far from their places there.
    in_step = (F.col("first_h") == F.col("h")) | (before("away") == F.col("away"))
    touches = before(F.col("start") + F.col("length")) >= F.col("start")
    runs = once.withColumn("new", (~F.coalesce(same_holder & in_step & touches, F.lit(False))).cast("int"))
    runs = runs.withColumn("on", F.when(F.col("new") == 0, F.pmod(F.col("chunk") - before("chunk"), F.lit(1 << CHUNK_BITS))).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(order))
    passages = (
        runs.groupBy("h", "run")
        .agg(
            F.min("start").alias("start_byte"),
            (F.max(F.col("start") + F.col("length")) - F.min("start")).cast("long").alias("n_bytes"),
            (F.sum("on") + F.max_by("n", F.struct("start", "length"))).cast("long").alias("n_chunks"),
            F.min("first_id").alias("first_id"),
        )
        .where(F.col("n_bytes") >= min_bytes)
        .drop("run")
    )
    holders = rows.select("id", "h").distinct()
    return holders.join(passages, "h").select("id", "start_byte", "n_bytes", "n_chunks", "first_id")


def _free(name: str, docs: DataFrame) -> str:
    """A name that no column has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while f"__{name}" in taken:
        name = f"_{name}"
    return f"__{name}"


def remove_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every passage removed that an earlier document holds first.

    All columns stay, whatever their names; a null id or null text passes unchanged.
    """
    own_id, own_spans = _free("id", docs), _free("spans", docs)
    spans = (
        repeats.where("first_id < id")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("start_byte", "n_bytes"))).alias(own_spans))
        .withColumnRenamed("id", own_id)
    )

    def cut(raws: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for raw, own in zip(raws, spans, strict=True):
            if raw is None or own is None or not len(own):
                out.append(None if raw is None else bytes(raw).decode())
                continue
            keep, at = [], 0
            for span in own:
                keep.append(raw[at : span["start_byte"]])
                at = max(at, span["start_byte"] + span["n_bytes"])
            out.append(b"".join([*keep, raw[at:]]).decode())
        return pd.Series(out, dtype="object")

    joined = docs.join(spans, F.col(id_col) == F.col(own_id), "left")
    cleaned: Column = F.pandas_udf(cut, "string")(F.col(text_col).cast("binary"), F.col(own_spans))
    return joined.withColumn(text_col, cleaned).drop(own_id, own_spans)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every repeated passage of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_repeats(docs).select(
        F.col("id").alias("doc_id"),
        "start_byte",
        "n_bytes",
        "n_chunks",
        F.col("first_id").alias("first_doc_id"),
        (F.col("first_id") == F.col("id")).alias("is_first"),
    )
