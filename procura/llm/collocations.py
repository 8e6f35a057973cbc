"""Phrases that stand out in each language: collocations by bucket counts and Apriori pruning (PCY, DHP).

A phrase is up to ``max_words`` adjacent words of one piece of text. Pass k over the
texts counts the candidate phrases of k words exactly and, hashed into buckets, the
phrases of k + 1 words. The buckets that reach the least count, one bit each, are
broadcast to the next pass, and so are the hashes of the frequent phrases of k words:
a phrase is counted only if its bucket is frequent and both phrases within it that are
one word shorter are (Apriori). Hashes only rule out: no frequent phrase is lost, and
the exact counts decide.

Bounds: a task holds one stretch of text, ``VOCABULARY`` words and ``HELD`` phrases at
most and hands on partial counts when either is full; a piece without any mark is one
stretch, whatever its length. The bit tables have ``max_buckets`` bits at most (32 MB);
beyond that many buckets' worth of text they rule out less, and results stay the same.
Counts are combined before they are shuffled, so a frequent word or language is no hot key.

Defined results: a null text is empty; a null language is ``und``; empty and repeated
texts, ties and an empty table need no exception; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.workspace import broadcast_object, materialise, shuffle_partitions

UNKNOWN = "und"
MIN_COUNT = 10
TOP, DEALT = 2000, 32
#: Buckets: one for every so many bytes of text, a power of two within these bounds.
BYTES_PER_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 8, 1 << 16, 1 << 28
#: Of a task: words with a number of their own, phrases not handed on yet, over all languages; bytes of a stretch of text.
VOCABULARY, HELD, STRETCH = 1 << 19, 3 << 19, 1 << 20
#: Words counted at a time. With them, a task's words have numbers below ``BASE``; three of those fit in a long.
WINDOW, BASE = 1 << 18, 1 << 20
#: Bits of a bucket's number within its block.
BLOCK = 16
#: A mark ends a piece; all marks become full stops, tabs spaces.
MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
END = b"."
PARTIAL = "lang string, phrase string, block int, cells binary, n long"


# --- words and their hashes -------------------------------------------------


def stretches(raw: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """A text in lower case (A-Z), its marks made equal, cut behind marks."""
    raw = raw.lower().translate(MARKS)  # on bytes, this lowers A-Z only
    at = 0
    while len(raw) - at > size:
        cut = raw.rfind(END, at, at + size)
        cut = raw.find(END, at + size) if cut < 0 else cut
        if cut < 0:
            break
        yield raw[at : cut + 1]
        at = cut + 1
    yield raw[at:]


class Words(dict):
    """Numbers of a language's words in one task, in order of appearance, and their hashes. Number 0 is the end of a piece."""

    def __init__(self, lang: str) -> None:
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.spelled = [END]
        self[END] = 0
        self._hashes = np.zeros(1, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.spelled)
        self.spelled.append(word)
        return number

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    @property
    def hashes(self) -> np.ndarray:
        fresh = [xxhash.xxh64_intdigest(w, self.seed) for w in self.spelled[len(self._hashes) :]]
        if fresh:
            self._hashes = np.concatenate([self._hashes, np.array(fresh, dtype=np.uint64)])
        return self._hashes


def buckets_of(hashes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """The bucket of the phrase of ``size`` words that begins at each place; ``hashes`` are those of the words."""
    mixed = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        mixed = (mixed + hashes[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def bit_at(table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (table[buckets >> np.uint64(3)] >> (buckets & np.uint64(7)).astype(np.uint8)) & 1 == 1


# --- bit tables -------------------------------------------------------------


def cells_of(buckets: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Block by block the buckets that occur, as places in it and counts; counts end at 255, which is frequent by then."""
    found, counts = np.unique(buckets, return_counts=True)
    blocks = (found >> np.uint64(BLOCK)).astype(np.int64)
    places = (found & np.uint64((1 << BLOCK) - 1)).astype("<u2")
    counts = np.minimum(counts, 255).astype(np.uint8)
    starts = np.flatnonzero(np.diff(blocks, prepend=-1)).tolist()
    for a, b in pairwise([*starts, len(blocks)]):
        yield int(blocks[a]), places[a:b].tobytes() + counts[a:b].tobytes()


def _merged(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by block become one row a block: its bits. One block at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << BLOCK, dtype=np.uint16)

        def bits() -> pa.RecordBatch:
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, cells in zip(batch["block"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield bits()
                    now = block
                    total[:] = 0
                n = len(cells) // 3
                places = np.frombuffer(cells, dtype="<u2", count=n)
                total[places] = np.minimum(total[places] + np.frombuffer(cells, dtype=np.uint8, offset=2 * n), 255)
        if now is not None:
            yield bits()

    return run


def bit_table(cells: DataFrame, bits: int, least: int) -> np.ndarray:
    """The buckets whose count is ``least`` (255 at most) or more, as 2**bits bits. This, of bounded size, passes through the driver."""
    sorted_ = cells.select("block", "cells").repartition(shuffle_partitions(cells.sparkSession), "block").sortWithinPartitions("block")
    table = np.zeros(max((1 << bits) // 8, 1 << (BLOCK - 3)), dtype=np.uint8)
    width = 1 << (BLOCK - 3)
    for row in sorted_.mapInArrow(_merged(least), "block int, bits binary").collect():
        table[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return table


def _phrase_cells(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True):
                words = phrase.encode().split(b" ")
                seed = xxhash.xxh64_intdigest(lang.encode())
                hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)
                found.append(buckets_of(hashes, len(words), bits))
            if found:
                blocks, cells = zip(*cells_of(np.concatenate(found)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], names=["block", "cells"])

    return run


# --- passes -----------------------------------------------------------------


class _Counts:
    """Partial counts of one task and language: candidates of ``size`` words, buckets of ``size + 1``."""

    def __init__(self, lang: str, size: int, bits: int, ahead: bool, frequent: np.ndarray | None, shorter: np.ndarray | None) -> None:
        self.lang, self.size, self.bits, self.ahead, self.frequent, self.shorter = lang, size, bits, ahead, frequent, shorter
        self.words, self.keys, self.next, self.held = Words(lang), [], [], 0
        #: Counts of single words by number; they take no room beyond the vocabulary, so only buckets fill a task in the first pass.
        self.singles = np.zeros(0, dtype=np.int64)

    def add(self, raw: bytes) -> Iterator[pa.RecordBatch]:
        """Count one stretch of text; hands on what is full."""
        tokens = raw.replace(END, b" . ").split()  # of white space, only spaces are left
        for at in range(0, len(tokens), WINDOW):
            self._count(self.words.numbers(tokens[at : at + WINDOW + self.size]))
            if self.held >= HELD or len(self.words) >= VOCABULARY:
                yield from self.drained()

    def size_of(self) -> float:
        """What it holds, as a share of what a task may. Words and their counts are those of the vocabulary."""
        return max(self.held / HELD, len(self.words) / VOCABULARY)

    def _count(self, numbers: np.ndarray) -> None:
        """Phrases that begin at the first ``WINDOW`` words; those behind complete them."""
        size = self.size
        if len(numbers) < size:
            return
        hashes = self.words.hashes[numbers]
        open_ = numbers != 0
        here = np.ones(len(numbers) - size + 1, dtype=bool)  # no end of a piece in it
        for k in range(size):
            here &= open_[k : k + len(here)]
        if size > 1:
            part = bit_at(self.shorter, buckets_of(hashes, size - 1, self.bits))
            here &= part[: len(here)] & part[1 : len(here) + 1]
            here &= bit_at(self.frequent, buckets_of(hashes, size, self.bits))
        if size == 1:
            counts = np.bincount(numbers[:WINDOW], minlength=max(len(self.words), len(self.singles)))
            counts[: len(self.singles)] += self.singles
            self.singles = counts
        else:
            places = np.flatnonzero(here[:WINDOW])
            key = np.zeros(len(places), dtype=np.int64)
            for k in range(size):
                key = key * BASE + numbers[places + k]
            self.keys.append(key)
            self.held += len(key)
        if self.ahead:
            both = here[:-1] & here[1:]  # both phrases in it are candidates
            self.next.append(buckets_of(hashes, size + 1, self.bits)[both].astype(np.uint32))  # ``MAX_BUCKETS`` fit
            self.held += int(both.sum())

    def drained(self) -> Iterator[pa.RecordBatch]:
        """Hand on what fills up; counts of single words stay until the vocabulary is full."""
        if self.size == 1 and len(self.words) < VOCABULARY:
            yield from self._cells()
        else:
            yield from self.partial()

    def partial(self) -> Iterator[pa.RecordBatch]:
        if self.size == 1:
            keys = np.flatnonzero(self.singles[1:]) + 1  # without ends of pieces
            n = self.singles[keys]
        else:
            keys, n = np.unique(np.concatenate(self.keys or [np.zeros(0, dtype=np.int64)]), return_counts=True)
        spelled = self.words.spelled
        for at in range(0, len(keys), 1 << 16):
            left, columns = keys[at : at + (1 << 16)], []
            for _ in range(self.size):
                columns.append((left % BASE).tolist())
                left = left // BASE
            phrases = [b" ".join(spelled[i] for i in of).decode("utf-8", "replace") for of in zip(*reversed(columns), strict=True)]
            yield self._rows(phrase=phrases, n=n[at : at + (1 << 16)])
        yield from self._cells()
        self.singles = np.zeros(0, dtype=np.int64)
        if len(self.words) >= VOCABULARY:
            self.words = Words(self.lang)

    def _cells(self) -> Iterator[pa.RecordBatch]:
        """Hand on the buckets and begin anew."""
        if self.next:
            blocks, cells = [], []
            for block, cell in cells_of(np.concatenate(self.next)):
                blocks.append(block)
                cells.append(cell)
            if blocks:
                yield self._rows(block=blocks, cells=cells)
        self.keys, self.next, self.held = [], [], 0

    def _rows(self, phrase=None, block=None, cells=None, n=None) -> pa.RecordBatch:
        rows = len(phrase if phrase is not None else block)
        none = [None] * rows
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.lang] * rows, pa.string()), pa.array(none if phrase is None else phrase, pa.string()), pa.array(none if block is None else block, pa.int32()),
                pa.array(none if cells is None else cells, pa.binary()), pa.array(none if n is None else n, pa.int64()),
            ],
            names=["lang", "phrase", "block", "cells", "n"],
        )


def _pass(docs: DataFrame, size: int, bits: int, ahead: bool, frequent: np.ndarray | None, shorter: np.ndarray | None) -> DataFrame:
    """One pass over (lang, text): partial counts of phrases of ``size`` words and of buckets of longer ones, in one table."""
    tables = broadcast_object(docs.sparkSession, (frequent, shorter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, _Counts] = {}
        bits_frequent, bits_shorter = tables()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                counts = of.get(lang)
                if counts is None:
                    counts = of[lang] = _Counts(lang, size, bits, ahead, bits_frequent, bits_shorter)
                for raw in stretches(text.as_buffer().to_pybytes()):
                    yield from counts.add(raw)
                # All languages together hold what one may; each costs a little besides.
                while sum(c.size_of() for c in of.values()) + len(of) / 64 > 1:
                    largest = max(of, key=lambda x: of[x].size_of())
                    if size == 1 and of[largest].held > HELD // 8:
                        yield from of[largest].drained()
                    else:
                        yield from of.pop(largest).partial()
        for counts in of.values():
            yield from counts.partial()

    return materialise(docs.mapInArrow(run, PARTIAL), f"phrases-{size}")


def phrase_counts(docs: DataFrame, max_words: int, min_count: int, lang_col: str = "lang", text_col: str = "text", max_buckets: int = MAX_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, phrase, size, f) of the phrases of one to ``max_words`` words that occur ``min_count`` times or more."""
    if not 2 <= max_words <= 3 or not 1 <= min_count <= 255:
        raise ValueError("max_words must be 2 or 3, min_count 1 to 255")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (min(max(n_bytes // BYTES_PER_BUCKET, MIN_BUCKETS), max_buckets) - 1).bit_length()
    found, frequent, shorter, totals = None, None, None, None
    for size in range(1, max_words + 1):
        ahead = size < max_words
        partial = _pass(texts, size, bits, ahead, frequent, shorter)
        counted = partial.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if size == 1:
            totals = partial.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        counted = materialise(counted.where(F.col("f") >= min_count).select("lang", "phrase", F.lit(size).alias("size"), "f"), f"frequent-{size}")
        if ahead:
            frequent = bit_table(partial.where("block IS NOT NULL"), bits, min_count)
            shorter = bit_table(counted.select("lang", "phrase").mapInArrow(_phrase_cells(bits), "block int, cells binary"), bits, 1)
        found = counted if found is None else found.unionByName(counted)
    return totals, found


def _words(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = MIN_COUNT, top: int = TOP, inside_percent: int = 50, lang_col: str = "lang", text_col: str = "text", max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two words or more.

    ``a``, ``l`` and ``r`` count the phrase and its two parts at the cut that scores
    lowest, floor(1,000,000 * a * a / (l * r)). A phrase inside a longer one that
    occurs ``inside_percent`` of a hundred times as often or more is left out. Decimals of 38
    digits hold the products.
    """
    totals, frequent = phrase_counts(docs, max_words, min_count, lang_col, text_col, max_buckets)
    candidates = frequent.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(1, F.col("k")).alias("first"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = frequent.select("lang", "phrase", "f")
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(SCORE))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    parts = candidates.where("size > 2").select("lang", "words", "size", "a", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    parts = parts.select("lang", "words", "a", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("at"))
    longer = parts.groupBy("lang", _words(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("cut.a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    shown = kept.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    # The first of each of ``DEALT`` parts of a language, then the first of those: no task sorts all of a language's phrases.
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    leading = shown.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top)
    ranked = leading.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: Counts up to 10**15 keep a million times their square within 38 digits; ``div`` gives a long.
SCORE = "(CAST(1000000 AS DECIMAL(7,0)) * CAST(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) AS DECIMAL(30,0))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two or three words."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS ws
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
        FROM documents)
), words AS (
    SELECT lang, w, lead(w, 1) OVER piece_order AS w2, lead(w, 2) OVER piece_order AS w3
    FROM (SELECT lang, piece, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM pieces)
    WINDOW piece_order AS (PARTITION BY piece ORDER BY place)
), occurrences AS (
    SELECT lang, 1 AS size, w AS phrase FROM words
    UNION ALL SELECT lang, 2, w || ' ' || w2 FROM words WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM words WHERE w3 IS NOT NULL
), counted AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM occurrences GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE size >= 2 AND f >= 10),
parts AS MATERIALIZED (
    SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), cuts AS (
    SELECT p.lang, p.phrase, p.a, p.k, x.f AS l, y.f AS r, (1000000::HUGEINT * p.a * p.a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM parts AS p JOIN counted AS x ON x.lang = p.lang AND x.phrase = p.head JOIN counted AS y ON y.lang = p.lang AND y.phrase = p.rest
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM candidates WHERE size = 3
), longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL),
ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
