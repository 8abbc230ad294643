"""Helpers that several operators share: reading, shared storage, folds, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.storage import discard, materialize, shared_dir, table

__all__ = ["BLANKS", "BLANK_RUN", "bounded_ids", "bucket_of", "clean_text", "discard", "fold", "materialize", "salted_join", "shared_dir", "spread", "table", "with_offsets", "word_count", "words"]

#: Characters that separate words: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[ \t-\r]+"


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than the cluster has cores, dealt over all of them.

    A small file of one row group is one task, whatever its work; tables of many files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def salted_join(rows: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join rows with a table of one row a key; a hot key is dealt over ``salts`` tasks by a hash of column ``by``.

    ``small`` is repeated ``salts`` times, so it has slim rows and fewer than ``rows``.
    """
    few = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(few, [key, "_salt"], how).drop("_salt")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts`` (a null key counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def clean_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than blanks."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.regexp_count(trimmed, F.lit(BLANK_RUN)) + 1).otherwise(0).cast("long")


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def bucket_of(hashed: Column, buckets: int) -> Column:
    """The bucket of a signed 64-bit hash; buckets follow the order of the hashes."""
    return F.floor((hashed.cast("double") / F.lit(2.0**64) + 0.5) * buckets).cast("int")


def bounded_ids(labels: DataFrame, where: Column, key: str, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` keys of labelled rows, those with the smallest seeded hash.

    A key with contradicting labels is taken if any of its rows qualifies.
    """
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    return labels.where(where & F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("one")).orderBy(hashed, key).limit(limit).select(key)


def with_offsets(rows: DataFrame, group: list[str], bucket: str, order: list, size: str | None, out: str) -> DataFrame:
    """Add ``out``: what stands before a row in its group, and ``out_all``: the group's total.

    What stands before is the number of earlier rows by ``order``, or with
    ``size`` the sum of their sizes. Group columns must not be null. ``bucket`` must
    rise with the order's leading key, so that a hot group is dealt over as many
    tasks as it has buckets. Sums of whole buckets are small (groups x buckets);
    running sums over them bring the buckets together.
    """
    amount = F.lit(1) if size is None else F.col(size)
    keys = [*group, bucket]
    sums = rows.groupBy(*keys).agg(F.sum(amount).cast("long").alias("_in"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"), F.sum("_in").over(whole).alias(f"{out}_all"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return local.join(sums, keys).withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_before")
