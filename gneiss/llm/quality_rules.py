"""Quality rules: hashed n-gram log-likelihood ratio, DataFrame functions only.

Two multinomials over hashed word n-grams are counted: one over trusted
documents (a bounded sample of those labelled as good), one over the whole raw
corpus. A document's score is the sum of log(p_trusted / p_raw) over its
n-grams, divided by their number. It is kept if it passes the base rules and its
score reaches a fixed threshold, which is the same for each document and each
corpus size.

Edge cases: a null text counts as empty: no words, score 0, base rules failed.
Rows with equal doc_id are scored one by one. Without trusted rows both
multinomials are flat for a target and each score is the negative surprise
of the raw corpus; pass labels that hold trusted rows. An empty table gives an
empty result. Extra columns of the input are carried through, whatever their names; ``quality_rules``
replaces those that clash with an output column by it, ``kept_documents`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import BLANKS, bounded_ids, clean_text, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words and runs of punctuation, as two kinds of token.
TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)"

BUCKETS = 16384
TRUSTED_LIMIT = 20_000
THRESHOLD = -0.3
MIN_WORDS = 50
#: Repeated windows up to which each position is looked up among them.
FEW = 16

SCORED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def with_ngrams(df: DataFrame, text: Column, buckets: int, name: str = "_ids") -> DataFrame:
    """Add the hashed buckets of all unigrams and bigrams of the lower-cased tokens.

    ``buckets`` is a power of two. Tokens are hashed once; a bigram mixes two hashes.
    """
    mask = F.lit(buckets - 1).cast("long")
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))
    h, pairs = F.col("_h"), F.greatest(F.size("_h") - 1, F.lit(0))
    one = F.transform(h, lambda a: a.bitwiseAND(mask))
    two = F.zip_with(F.slice(h, 1, pairs), F.slice(h, 2, pairs), lambda a, b: F.shiftright(a, 7).bitwiseXOR(b).bitwiseAND(mask))
    return df.withColumn("_h", F.transform(tokens, lambda t: F.xxhash64(t))).withColumn(name, F.concat(one, two)).drop("_h")


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_limit: int = TRUSTED_LIMIT, seed: int = 10) -> list[float]:
    """log(p_trusted / p_raw) of each bucket.

    Raw counts cover every row. Trusted ones cover at most ``trusted_limit``
    documents labelled as good, chosen by seeded hash. What reaches the driver
    has ``buckets`` rows.
    """
    trusted = bounded_ids(labels, F.col("quality") == 1, "doc_id", trusted_limit, seed).withColumn("_trusted", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")
    counted = (
        with_ngrams(rows, clean_text(), buckets)
        .select("_trusted", F.explode(F.transform("_ids", lambda x: x.cast("int"))).alias("bucket"))  # of a bare column, a filter would compute it anew
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("good"))
        .collect()
    )
    raw, good = [1] * buckets, [1] * buckets
    for r in counted:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    all_raw, all_good = sum(raw), sum(good)
    return [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good, raw, strict=True)]


def base_rules(df: DataFrame) -> DataFrame:
    """Add the base counts and ``base_failed`` to rows with a text.

    Windows of three words are compared by a 64-bit hash. Most texts repeat none or
    few of them; only those with many sort windows together with positions.
    """
    text = clean_text()
    w, h, g, dup, at = F.col("_words"), F.col("_h"), F.col("_g"), F.col("_dup"), F.col("_at")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    n = F.greatest(F.size(h) - 2, F.lit(0))
    windows = F.zip_with(
        F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.shiftleft(a, 2).bitwiseXOR(F.shiftleft(b, 1))),
        F.slice(h, 3, n),
        lambda a, b: a.bitwiseXOR(b),
    )
    s = F.col("_sorted")
    repeated = F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
    none = F.array().cast("array<int>")
    few = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(dup, x), i)), lambda x: x.isNotNull())
    pairs = F.col("_pairs")
    many = F.sort_array(
        F.transform(
            F.filter(
                F.transform(pairs, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))).alias("r"))),
                lambda x: x["r"],
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return (
        df.withColumn("_words", words(text))
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_h", F.transform(w, lambda x: F.xxhash64(x)))
        .drop("_words", "_lines")
        .withColumn("_g", windows)
        .withColumn("_sorted", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(g)))
        .withColumn("_dup", repeated)
        .withColumn("_pairs", F.when(F.size(dup) > FEW, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
        .withColumn("_at", F.when(dup.isNull(), none).when(F.size(dup) <= FEW, few).otherwise(many))
        .withColumn("n_repeat_words", covered)
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_h", "_g", "_sorted", "_dup", "_pairs", "_at")
    )


def score(df: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``kept``. The table goes into the plan as one constant array."""
    packed = F.split(F.lit(",".join(repr(x) for x in table)), ",").cast("array<double>")
    ids = F.col("_ids")
    total = F.aggregate(ids, F.lit(0.0), lambda a, b: a + F.get(packed, b.cast("int")))
    return (
        with_ngrams(df, clean_text(), len(table))
        .withColumn("score", F.when(F.size(ids) > 0, total / F.size(ids)).otherwise(0.0))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .drop("_ids")
    )


def packed(docs: DataFrame) -> DataFrame:
    """Text beside one column with all others, so that no name of theirs meets a name used here."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_own"))


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("text") if c == "text" else F.col("_own").getField(c).alias(c) for c in columns]


def judged(docs: DataFrame, labels: DataFrame, threshold: float, buckets: int) -> DataFrame:
    return score(base_rules(packed(docs)), weights(docs, labels, buckets), threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``docs`` with its base counts, score and verdict."""
    return judged(docs, labels, threshold, buckets).select(*unpacked([c for c in docs.columns if c not in SCORED]), *SCORED)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    The row number keeps Spark from pushing the filter below the steps that make
    the verdict, where it would repeat each of them.
    """
    rows = judged(docs, labels, threshold, buckets).withColumn("_row", F.monotonically_increasing_id())
    return rows.where(F.col("kept") & (F.col("_row") >= 0)).select(*unpacked(docs.columns))
