"""Benchmark decontamination with a generalised suffix automaton.

All test items, as word numbers, go into one automaton. A training text
streams through it: the state after a word and the matched length give the
longest item passage that ends there. Words inside a window (13 consecutive
item words, or a whole item that is shorter) are hit. Texts are cut beforehand
at words or word pairs that no item has; the automaton falls back to a match of
at most one word there, so the cut changes nothing.

Only automata go to the executors, as arrays of some 80 bytes an item word.
Items are counted first and dealt to blocks of at most ``BLOCK_WORDS`` words,
one automaton each, built on the driver one after the other. Texts pass through
``PASS_BLOCKS`` of them at a time; a larger benchmark takes further passes, each
of which writes spans by digest of the text, for the end to put together. So the memory of the driver and of a
worker stays the same however large the benchmark is.

Defined results: a null or wordless text has no words, no hits and isn't
contaminated; a null or wordless item takes no part, and neither does a null
item id; repeated items count once by id; an empty benchmark hits nothing;
an empty table gives an empty result; other columns are kept by
``measured`` and ignored by the query.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.workspace import broadcast_object, materialise

WINDOW = 13
#: A-Z become a-z; all other ASCII but digits and letters separates words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Item words of one automaton, and automata of one pass over the texts.
BLOCK_WORDS, PASS_BLOCKS = 200_000, 8
MEASURE = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, longest int"


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(WORD_BYTES).split() if raw else []


class ItemAutomaton:
    """A suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        sequences = []
        for name, raw in items:
            words = words_of(raw)
            if words:
                sequences.append((name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        self.width = len(self.vocab) + 1
        self.next: dict[int, int] = {}  # state * width + word -> state, while building
        self.link, self.length = array("i", [-1]), array("i", [0])
        leaving: list[list[int]] = [[]]  # words that leave each state
        for _, words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word, leaving)
        self.chains: dict[int, list[tuple[int, int, str]]] = {}  # filled on demand
        pairs = {a * self.width + b for _, words in sequences for a, b in zip(words, words[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.least = min([window, *(len(words) for _, words in sequences)])
        self.names = [name for name, _ in sequences]
        ending: set[tuple[int, int]] = set()  # (state, item) of the items' windows
        self.short_items: dict[int, list[tuple[int, str]]] = {}
        for item, (name, words) in enumerate(sequences):
            state = 0
            for at, word in enumerate(words):
                state = self.next[state * self.width + word]
                if at + 1 >= window:
                    state = self.floor(state)
                    ending.add((state, item))
            if len(words) < window:
                self.short_items.setdefault(state, []).append((len(words), name))
        self.window_states, self.window_items = (array("i", x) for x in zip(*sorted(ending), strict=True)) if ending else (array("i"), array("i"))
        self.keys = array("q", sorted(self.next))
        self.targets = array("i", [self.next[k] for k in self.keys])
        self.next = {}

    def follow(self, state: int, word: int) -> int | None:
        """The state that a word leads to."""
        key = state * self.width + word
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else None

    def items_at(self, state: int) -> set[str]:
        """The items with a window that ends in a state."""
        own = slice(bisect_left(self.window_states, state), bisect_right(self.window_states, state))
        return {self.names[i] for i in self.window_items[own]}

    def _extend(self, last: int, word: int, leaving: list[list[int]]) -> int:
        width, follow, link, length = self.width, self.next, self.link, self.length
        known = follow.get(last * width + word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, word, known, leaving)
        new = self._state(length[last] + 1, leaving)
        at = last
        while at != -1 and at * width + word not in follow:
            follow[at * width + word] = new
            leaving[at].append(word)
            at = link[at]
        if at != -1:
            known = follow[at * width + word]
            link[new] = known if length[known] == length[at] + 1 else self._clone(at, word, known, leaving)
        return new

    def _state(self, length: int, leaving: list[list[int]]) -> int:
        self.link.append(0)
        self.length.append(length)
        leaving.append([])
        return len(self.link) - 1

    def _clone(self, at: int, word: int, known: int, leaving: list[list[int]]) -> int:
        """Split off from ``known`` the shorter strings, which occur in more places."""
        width, follow = self.width, self.next
        copy = self._state(self.length[at] + 1, leaving)
        self.link[copy] = self.link[known]
        for other in leaving[known]:
            follow[copy * width + other] = follow[known * width + other]
        leaving[copy] = list(leaving[known])
        self.link[known] = copy
        while at != -1 and follow.get(at * width + word) == known:
            follow[at * width + word] = copy
            at = self.link[at]
        return copy

    def floor(self, state: int) -> int:
        """The state of the last ``window`` words of a match that is at least as long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def shorts(self, state: int) -> list[tuple[int, int, str]]:
        """(state, length, item) of the short items that end where ``state`` ends."""
        found = self.chains.get(state)
        if found is None:
            found, at = [], state
            while at > 0:
                found += [(at, n, name) for n, name in self.short_items.get(at, ())]
                at = self.link[at]
            self.chains[state] = found
        return found

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where a window can be: runs of known words in which every pair follows in some item."""
        if len(ids) < max(1, self.least):
            return []
        known = ids >= 0
        joined = np.zeros(len(ids) - 1, dtype=bool)
        if len(self.pairs):
            code = ids[:-1].astype(np.int64) * self.width + ids[1:]
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined = (self.pairs[place] == code) & known[:-1] & known[1:]
        # Run starts: a word not joined to the one before it.
        starts = np.flatnonzero(np.concatenate(([True], ~joined)))
        ends = np.concatenate((starts[1:], [len(ids)]))
        fit = (ends - starts >= self.least) & known[starts]
        return list(zip(starts[fit].tolist(), ends[fit].tolist(), strict=True))

    def scan(self, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set[str], int]:
        """Number of words, hit spans (start, end), items found, and the longest match."""
        words = words_of(raw)
        return len(words), *self.scan_words(words)

    def scan_words(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (start, end), items found, and the longest match."""
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int32)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        follow, link, length, window = self.follow, self.link, self.length, self.window
        for a, b in self.stretches(ids):
            state, n = 0, 0
            for at, word in enumerate(ids[a:b].tolist(), a + 1):
                to = follow(state, word)
                while to is None and state:
                    state = link[state]
                    n = length[state]
                    to = follow(state, word)
                state, n = (0, 0) if to is None else (to, n + 1)
                longest = max(longest, n)
                back = 0
                if n >= window:
                    items |= self.items_at(self.floor(state))
                    back = window
                if self.short_items and state:
                    for end, size, name in self.shorts(state):
                        if end != state or size <= n:
                            items.add(name)
                            back = max(back, size)
                if back:
                    if spans and at - back <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], at - back), at)
                        while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                            _, end = spans.pop()
                            spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((at - back, at))
        return spans, items, longest


def build_automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[ItemAutomaton]:
    """One automaton for each block of items; the number of words decides how many blocks."""
    raw = F.col(text_col).cast("binary")
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("name"), raw.alias("raw"), F.octet_length(text_col).alias("bytes")
    )
    size = items.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-size // (2 * BLOCK_WORDS)))  # a word and its separator take two bytes at least
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("name", "raw"), F.lit(blocks)) == block).select("name", "raw").distinct()
        found = ItemAutomaton([(r["name"], bytes(r["raw"])) for r in mine.collect()])
        if found.vocab:
            yield found


def _joined(spans: Iterable[tuple[int, int]]) -> list[dict]:
    """Spans in order, those that meet as one."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return [{"start": a, "end": b} for a, b in merged]


def measure(text: Column, automata: Iterable[ItemAutomaton], spark) -> Column:
    """struct(n_words, spans, items, longest) of a string column; spans count words."""
    shared = [broadcast_object(spark, a) for a in automata]

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = [get() for get in shared]
        for texts in parts:
            rows = []
            for raw in texts:
                words = words_of(raw)
                spans, items, longest = [], set(), 0
                for automaton in own:
                    more, names, most = automaton.scan_words(words)
                    spans, items, longest = spans + more, items | names, max(longest, most)
                rows.append((len(words), _joined(spans), sorted(items), longest))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items", "longest"])

    return F.pandas_udf(batches, MEASURE)(text.cast("binary"))


def merged(found: Column) -> Column:
    """One measure from those of several passes over the same text."""

    def together(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for passes in parts:
            spans = [(x["start"], x["end"]) for p in passes for x in p["spans"]]
            items = {name for p in passes for name in p["items"]}
            rows.append((passes[0]["n_words"], _joined(spans), sorted(items), max(p["longest"] for p in passes)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items", "longest"])

    return F.pandas_udf(together, MEASURE)(found)


def measured(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``name`` of ``measure``, over as many passes as the benchmark needs.

    One pass needs no shuffle. With more, each pass reads the texts where they are
    and writes what it found by the text's digest, equal texts once; a text's
    passes are then put together and joined to ``docs``. No pass writes a text.
    """
    automata = build_automata(benchmark)
    spark, text = docs.sparkSession, F.col(text_col)
    batch = list(islice(automata, PASS_BLOCKS))
    more = list(islice(automata, PASS_BLOCKS))
    if not more:
        return docs.withColumn(name, measure(text, batch, spark))
    digest = F.sha2(text.cast("binary"), 256)
    parts = []
    while batch:
        found = docs.where(text.isNotNull()).select(digest.alias("key"), measure(text, batch, spark).alias("m"))
        parts.append(materialise(found.groupBy("key").agg(F.first("m").alias("m")), "decontamination-pass"))
        batch, more = more, list(islice(automata, PASS_BLOCKS))
    all_passes = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.collect_list("m").alias("m"))  # one entry a pass
    key, measures = f"__{name}_key", f"__{name}_found"
    while key in docs.columns or measures in docs.columns:
        key, measures = key + "_", measures + "_"
    known = all_passes.select(F.col("key").alias(key), merged(F.col("m")).alias(measures))
    wordless = F.from_json(F.lit('{"n_words":0,"spans":[],"items":[],"longest":0}'), MEASURE)
    joined = docs.withColumn(key, digest).join(known, key, "left")
    return joined.withColumn(name, F.coalesce(measures, wordless)).drop(key, measures)


def hit_words(measured: Column) -> Column:
    return F.aggregate(measured["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """One word in twenty or more lies in a window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def strip_spans(text: Column, measured: Column) -> Column:
    """The text without its hit spans; what separated them stays."""

    def batches(texts: pd.Series, found: pd.DataFrame) -> pd.Series:
        out = []
        for raw, spans in zip(texts, found["spans"], strict=True):
            if raw is None or not len(spans):
                out.append(None if raw is None else bytes(raw).decode())
                continue
            plain = np.frombuffer(bytes(raw).translate(WORD_BYTES), dtype=np.uint8)
            inside = np.concatenate(([False], plain != 32, [False]))
            starts = np.flatnonzero(inside[1:] & ~inside[:-1])
            ends = np.flatnonzero(inside[:-1] & ~inside[1:])
            keep, at = [], 0
            for span in spans:
                keep.append(raw[at : starts[span["start"]]])
                at = ends[span["end"] - 1]
            out.append(b"".join([*keep, raw[at:]]).decode())
        return pd.Series(out, dtype="object")

    return F.pandas_udf(batches, "string")(text.cast("binary"), measured)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hits and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = measured(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "m")
    n_hit = hit_words(F.col("m"))
    return found.select(
        "doc_id",
        F.col("m.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("m.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("m.items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("m.n_words")).alias("contaminated"),
    )


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM iw, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM wins
), dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), occ AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM dwin d JOIN wins x ON d.win = x.win AND d.n = x.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
