"""Language identification: words first, then ever shorter character n-grams.

A word that the model knows scores its log frequency in each language. An unseen
word falls back to its character n-grams of the longest length of which the model
knows any, from 4 down to 1. A document's sums over all words give a
posterior over the languages.

The model is fitted on a bounded sample of labelled rows: at most
``DOCS_PER_LANGUAGE`` for each language, those with the smallest seeded hash. Their words and
n-grams are counted by the executors. It keeps the most frequent words and n-grams of each language
(``WORDS_PER_LANGUAGE``, ``GRAMS_PER_LANGUAGE`` of each length), so it is broadcast
with a size that does not depend on the corpus. More than ``MOST_LANGUAGES`` languages are refused.

A word is a letter (general category L) and what letters and marks (M) follow; digits, and numbers
such as ``½`` or ``Ⅷ``, are none.

Edge cases: a text that is null or has no letter is `und` with score 0. With no
labelled row at all, every text is `und`. Ties between languages go to
the first by name. Repeated rows are predicted one by one. Whole texts are scored.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import discard, fold, materialize

DOCS_PER_LANGUAGE = 1_000
#: Languages beyond this many are refused.
MOST_LANGUAGES = 400
WORDS_PER_LANGUAGE = 30_000
GRAMS_PER_LANGUAGE = 30_000
LONGEST = 4
#: What a language that lacks a word or n-gram scores below its rarest one.
MISSING = 2.0
FOLDS, HELD_OUT = 3, 1
SEED = 5
MEMORY = 300_000

#: Words where a text has no marks and no numbers but digits, and words of any text.
PLAIN = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@cache
def uncommon() -> frozenset[str]:
    """Marks, and numbers that ``PLAIN`` takes for letters."""
    kinds = {"Mn", "Mc", "Me", "No", "Nl"}
    return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in kinds)


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text."""
    text = text.lower()
    return (PLAIN if text.isascii() or uncommon().isdisjoint(text) else LETTERS).findall(text)


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between boundaries."""
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies: a row of numbers, one for each language, for each known word or n-gram.

    ``counts`` has a table for words (0) and for n-grams of each length: language, then word or n-gram, then
    count; ``totals`` the sums of all counts, those left out as well.
    """

    def __init__(self, languages: list[str], counts: dict[int, dict[str, dict[str, int]]], totals: dict[int, dict[str, int]]):
        self.languages = sorted(languages)
        tables = {n: self._table({x: counts[n].get(x, {}) for x in self.languages}, totals[n]) for n in range(LONGEST + 1)} if self.languages else {n: {} for n in range(LONGEST + 1)}
        self.words, self.grams = tables[0], {n: tables[n] for n in range(1, LONGEST + 1)}

    def _table(self, counts: dict[str, dict[str, int]], totals: dict[str, int]) -> dict[str, np.ndarray]:
        floor = min((math.log(min(c.values()) / totals[x]) for x, c in counts.items() if c), default=0.0) - MISSING
        out: dict[str, np.ndarray] = {}
        for k, x in enumerate(self.languages):
            for g, n in counts[x].items():
                row = out.get(g)
                if row is None:
                    row = out[g] = np.full(len(self.languages), floor, np.float32)
                row[k] = math.log(n / totals[x])
        return out

    def word_row(self, word: str) -> np.ndarray:
        """Known words by their own frequency, others by the mean of the longest known n-grams."""
        row = self.words.get(word)
        if row is not None:
            return row
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            rows = [table[g] for g in grams_of(word, n) if g in table]
            if rows:
                return rows[0] if len(rows) == 1 else np.add.reduce(rows) / np.float32(len(rows))
        return np.zeros(len(self.languages), np.float32)


class Predictor:
    """Predicts texts, with a bounded memory of word rows."""

    def __init__(self, model: Model, memory: int = MEMORY):
        self.model, self.memory = model, memory
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)), np.float32)

    def _id(self, word: str) -> int:
        k = self.ids[word] = len(self.ids)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.model.word_row(word)
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text else []
        if not found or not self.model.languages:
            return "und", 0.0
        if len(self.ids) > self.memory:
            self._forget()
        ids, new = self.ids, self._id
        at = [ids[w] if w in ids else new(w) for w in found]
        total = self.rows[at].sum(axis=0, dtype=np.float64)
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return self.model.languages[best], float(odds[best] / odds.sum())


def counted(texts: DataFrame) -> DataFrame:
    """(lang, length, gram, k): counts of words (length 0) and n-grams of texts (lang, text)."""

    def words(batches):
        for batch in batches:
            found = Counter()
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(t))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "k"])

    def grams(batches):
        for batch in batches:
            found = Counter()
            for lang, w, k in zip(*(batch.column(c).to_pylist() for c in ("lang", "gram", "k")), strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        found[lang, n, g] += k
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["lang", "length", "gram", "k"])

    whole = texts.mapInArrow(words, "lang string, gram string, k long").groupBy("lang", "gram").agg(F.sum("k").alias("k"))
    whole = materialize(whole, "words")
    parts = whole.mapInArrow(grams, "lang string, length int, gram string, k long").groupBy("lang", "length", "gram").agg(F.sum("k").alias("k"))
    return whole.select("lang", F.lit(0).alias("length"), "gram", "k").unionByName(parts)


def model_of(counts: DataFrame, most_words: int = WORDS_PER_LANGUAGE, most_grams: int = GRAMS_PER_LANGUAGE) -> Model:
    """The model of counts (lang, length, gram, k): words that occur twice, and n-grams, the most frequent of each language."""
    counts = materialize(counts, "counts")
    totals: dict[int, dict[str, int]] = {n: {} for n in range(LONGEST + 1)}
    for r in counts.groupBy("lang", "length").agg(F.sum("k").alias("k")).collect():  # languages x lengths
        totals[r["length"]][r["lang"]] = r["k"]
    rank = F.row_number().over(Window.partitionBy("lang", "length").orderBy(F.desc("k"), "gram"))
    kept = counts.where("length > 0 OR k > 1").withColumn("_n", rank).where(F.col("_n") <= F.when(F.col("length") == 0, most_words).otherwise(most_grams))
    tables: dict[int, dict[str, dict[str, int]]] = {n: {} for n in range(LONGEST + 1)}
    for batch in kept.select("lang", "length", "gram", "k").toArrow().to_batches():
        for lang, n, g, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tables[n].setdefault(lang, {})[g] = k
    discard(counts)
    return Model(list(totals[0]), tables, totals)


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, seed: int = SEED) -> Model:
    """A model of a bounded sample of the labelled rows outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    spark = docs.sparkSession
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Model([], {}, {})
    # a hash threshold that leaves about twice the sample of each language, so that the ranking is small
    least = spark.createDataFrame([(r["lang"], min(1.0, (2 * per_language + 100) / r["n"])) for r in counts], "lang string, _share double")
    unit = hashed.cast("double") / F.lit(2.0**64) + 0.5
    few = rows.join(F.broadcast(least), "lang").where(unit <= F.col("_share")).select("lang", "doc_id", hashed.alias("_h"))
    ranked = few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_n") <= per_language).select("doc_id").distinct()
    # a doc_id counts once for a language
    chosen = rows.join(F.broadcast(ranked), "doc_id", "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return model_of(counted(chosen.select("lang", "text")))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            found = [predictor.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
