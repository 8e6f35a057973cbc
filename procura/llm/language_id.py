"""Language identification by multilingual mixture inference.

Each learned language is a distribution over hashed byte trigrams of letters.
A document is a mixture of languages: expectation-maximisation finds the
proportions that make its trigrams most likely, and the set of languages is the
one with the best likelihood after a penalty for each further language: it
grows by falling proportion until two further languages in turn don't pay. The
predicted language has the largest proportion, which is also the score. The
gain tells whether the text is in the learned languages at all: how much likelier
than by chance, as a logarithm, a trigram of it is under its mixture on the
average; below 0 it is in none of them.

The model is fitted on a bounded sample: about ``docs_per_language`` training
documents of each language, chosen by a hash of id and text. Languages count
over all training documents; of more than ``MAX_LANGUAGES`` labels the most
frequent are learned, of equally frequent ones those that sort first. Text alone
is the input of a prediction.

Defined results: text that is null or has no letter gives ``und`` with score 0,
no proportions and no gain, and so does every text if no language could be learned;
ties go to the language that sorts first; a null id is never held out; repeated
rows get equal predictions; an empty table gives an empty result; other columns
are kept by ``identify`` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.workspace import broadcast_object

BITS = 14
UNKNOWN = "und"
DOCS_PER_LANGUAGE = 4000
#: A model of more languages than this would no longer be small on the driver.
MAX_LANGUAGES = 512
#: Overlapping trigrams say the same thing about three times.
DEPENDENCE = 3.0
ROUNDS = 12
#: Numbers in the tables of one step of inference: features of its texts times languages.
STEP_VALUES = 16_000_000

#: Letters to lower case, other ASCII to a space; bytes of other scripts stay.
LETTER_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def trigrams(raw: bytes) -> np.ndarray:
    """Hashed byte trigrams that have a letter in the middle."""
    codes = np.frombuffer(b" " + raw.translate(LETTER_BYTES) + b" ", dtype=np.uint8)
    middle = codes[1:-1] != 32
    wide = codes.astype(np.uint32)
    packed = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[middle]
    return (packed * np.uint32(2654435761)) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # features x languages


def held_out(doc_id: Column) -> Column:
    digest = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(digest % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from the rows that aren't held out and have a text and a language."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = usable.groupBy(F.col(lang_col).cast("string").alias("lang")).count()
    found = {r["lang"]: r["count"] for r in counts.orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not found:
        return LanguageModel((), np.zeros((1 << BITS, 0)))
    languages = tuple(sorted(found))
    share = F.create_map(
        *[x for name, n in found.items() for x in (F.lit(name), F.lit(min(1.0, docs_per_language / n)))]
    )
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(draw < share[F.col(lang_col).cast("string")]).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("raw")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = sums.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                mine += np.bincount(trigrams(raw), minlength=1 << BITS)
        for lang, mine in sums.items():
            feature = np.flatnonzero(mine)
            names = pa.array([lang] * len(feature), pa.string())
            yield pa.record_batch([names, pa.array(feature), pa.array(mine[feature])], names=["lang", "f", "n"])

    rows = sample.mapInArrow(count, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n"))
    table = rows.toPandas()  # languages x 2**BITS rows at most
    total = np.full((1 << BITS, len(languages)), 0.5)
    place = {name: i for i, name in enumerate(languages)}
    total[table["f"].to_numpy(), table["lang"].map(place).to_numpy(dtype=int)] += table["n"].to_numpy()
    return LanguageModel(languages, np.log(total / total.sum(axis=0)))


def _mixture(like: np.ndarray, weight: np.ndarray, owner: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int):
    """Proportions (documents x languages) after some rounds, and each document's log-likelihood."""
    total = np.add.reduceat(weight, starts)[:, None]
    for _ in range(rounds):
        part = like * share[owner]
        part *= (weight / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total
    seen = np.log((like * share[owner]).sum(axis=1))
    return share, np.add.reduceat(weight * seen, starts)


def infer(model: LanguageModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages, and the gain of each text, not a number if it has no trigram."""
    n_lang = len(model.languages)
    out, gains = np.zeros((len(texts), n_lang)), np.full(len(texts), np.nan)
    features, weights, rows = [], [], []
    for i, raw in enumerate(texts):
        counts = np.bincount(trigrams(raw), minlength=1 << BITS)
        mine = np.flatnonzero(counts)
        if len(mine):
            features.append(mine)
            weights.append(counts[mine])
            rows.append(i)
    if not rows or not n_lang:
        return out, gains
    lengths = np.array([len(f) for f in features])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    owner = np.repeat(np.arange(len(rows)), lengths)
    weight = np.concatenate(weights).astype(float)
    logs = model.log_prob[np.concatenate(features)]
    like = np.exp(logs - logs.max(axis=1, keepdims=True))
    top = np.log(like)
    single = np.add.reduceat(weight[:, None] * top, starts, axis=0)
    total = np.add.reduceat(weight, starts)
    penalty = 0.5 * np.log(total) + 2.0
    share, _ = _mixture(like, weight, owner, starts, np.full((len(rows), n_lang), 1.0 / n_lang), ROUNDS // 2)
    # Sets of one: the likeliest language. Larger ones are nested, by proportion.
    best = np.zeros((len(rows), n_lang))
    best[np.arange(len(rows)), single.argmax(axis=1)] = 1.0
    value = single.max(axis=1) / DEPENDENCE - penalty
    order = np.argsort(-share, axis=1, kind="stable")
    paid = np.ones(len(rows), dtype=int)  # the largest set that gained
    for k in range(2, n_lang + 1):
        # Only documents whose k-th language has a share at all can gain from it.
        able = np.flatnonzero((share[np.arange(len(rows)), order[:, k - 1]] > 0.005) & (k - paid <= 2))
        if not len(able):
            break
        chosen = np.zeros((len(able), n_lang))
        np.put_along_axis(chosen, order[able, :k], np.take_along_axis(share[able], order[able, :k], axis=1), axis=1)
        chosen = np.maximum(chosen, 1e-12 * (chosen > 0))
        chosen /= chosen.sum(axis=1, keepdims=True)
        pick = np.isin(owner, able)
        place = np.full(len(rows), -1)
        place[able] = np.arange(len(able))
        sub_owner = place[owner[pick]]
        sub_starts = np.concatenate(([0], np.cumsum(lengths[able])[:-1]))
        found, seen = _mixture(like[pick], weight[pick], sub_owner, sub_starts, chosen, ROUNDS)
        gain = seen / DEPENDENCE - k * penalty[able]
        better = gain > value[able]
        best[able[better]] = found[better]
        value[able[better]] = gain[better]
        paid[able[better]] = k
    out[rows] = best
    seen = np.log((like * best[owner]).sum(axis=1)) + logs.max(axis=1)
    gains[rows] = np.add.reduceat(weight * seen, starts) / total + BITS * np.log(2)
    return out, gains


SCHEMA = "lang string, score double, languages array<string>, shares array<double>, gain double"


def identify(text: Column, model: LanguageModel, spark) -> Column:
    """struct(lang, score, languages, shares, gain) of a string column, the chosen set by falling share."""
    shared = broadcast_object(spark, model)

    def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        learned = shared()
        names = np.array(learned.languages, dtype=object)
        for raw, has_letter in parts:
            rows = []
            texts = [bytes(r) if r is not None and ok else b"" for r, ok in zip(raw, has_letter, strict=True)]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or (size + len(texts[end])) * len(names) < STEP_VALUES):
                    size += min(len(texts[end]), 1 << BITS)
                    end += 1
                shares, gains = infer(learned, texts[at:end])
                for share, gain in zip(shares, gains.tolist(), strict=True):
                    if gain != gain:
                        rows.append((UNKNOWN, 0.0, [], [], None))
                        continue
                    order = np.argsort(-share, kind="stable")
                    order = order[share[order] > 0]
                    rows.append((names[order[0]], min(1.0, float(share[order[0]])), names[order].tolist(), share[order].tolist(), gain))
                at = end
            yield pd.DataFrame(rows, columns=["lang", "score", "languages", "shares", "gain"])

    has_letter = F.coalesce(F.rlike(text, F.lit("\\p{L}")), F.lit(False))
    return F.pandas_udf(batches, SCHEMA)(text.cast("binary"), has_letter)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), model, spark).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.languages").alias("languages"), F.col("p.shares").alias("shares")
    )
