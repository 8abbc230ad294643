"""Sharding: proportional stratified interleaving, with row counts at most one apart.

Rows of each source are shuffled by a seeded hash and ranked. Rank k of n gets
the fraction (k + u) / n, where u, between 0 and 1, is the source's start. Sources of like size, in the order of a seeded
hash, take their starts from the golden-ratio sequence, so those with few rows lie evenly, too. All rows are
sorted by that fraction and cut into shards of equal count. So each shard has every
source in proportion, up to a row or two, and many small sources crowd out no large one.

Ranks come from bucketed offsets: no task holds more than one bucket of a source,
however hot the source. Rows equal in all that is returned are counted first and then numbered, and
the number takes part in the shuffle, so repeats of a row or null doc_ids fill no
single bucket. Only the key, source, size and checksum are shuffled.

Edge cases: a null source is a source of its own, a null doc_id is shuffled by size,
checksum and number, a null text has size 1 (no bytes, plus 1)
and the checksum of no bytes. Repeated rows get a slot each; which of two equal
rows gets which slot makes no difference. Equal texts are not kept together: the
law bounds row counts, and a large group of copies spreads over all shards. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import bucket_of, clean_text, materialize, with_offsets

SHARDS = 16
SEED = 3
GOLDEN = (5**0.5 - 1) / 2
#: Buckets of a source, and of the whole order; rows of a source a task, where their start is looked up.
BUCKETS = 2048
SALT_ROWS = 2_000


def shuffled(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and text_crc32 of every row, the source's key and the row's seeded hash."""
    own = ["doc_id", "source", "size", "text_crc32"]
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(clean_text()) + 1).cast("long").alias("size"),
        F.crc32(clean_text().cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    rows = counted.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_n"))
    # a non-null key of the source
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return rows.select(*own, key.alias("_s"), F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32", "_n").alias("_h"), "_n")


def starts(rows: DataFrame, seed: int = SEED, buckets: int = 256) -> DataFrame:
    """(_s, _n_all, _u): each source with its number of rows and its start."""
    sources = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n_all")).withColumn("_v", F.xxhash64(F.lit(seed), "_s"))
    sources = sources.withColumn("_d", (F.floor(F.log2("_n_all")) * buckets + bucket_of(F.col("_v"), buckets)).cast("int"))
    ranked = with_offsets(sources, [], "_d", ["_v", "_s"], None, "_r")
    return ranked.select("_s", "_n_all", F.expr(f"(_r + 0.5D) * {GOLDEN!r}D - floor((_r + 0.5D) * {GOLDEN!r}D)").alias("_u"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = materialize(shuffled(docs, seed), "sharding")
    # a source's start is looked up in more tasks the more rows the source has
    salts = lambda n: F.ceil(F.col(n) / SALT_ROWS).cast("int")
    sources = materialize(starts(rows, seed), "sources").select("_s", "_u", F.explode(F.sequence(F.lit(0), salts("_n_all") - 1)).alias("_salt"))
    rows = with_offsets(rows.withColumn("_b", bucket_of(F.col("_h"), buckets)), ["_s"], "_b", ["_h", "doc_id", "size", "text_crc32", "_n"], None, "_k")
    rows = rows.withColumn("_salt", F.pmod("_h", salts("_k_all")).cast("int")).join(sources, ["_s", "_salt"])
    rows = rows.withColumn("_f", (F.col("_k") + F.col("_u")) / F.col("_k_all")).withColumn("_c", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)).cast("int"))
    rows = with_offsets(rows, [], "_c", ["_f", F.xxhash64(F.lit(seed), "_s", "_k"), "_s"], None, "_at")
    return rows.withColumn("shard", F.expr(f"cast(_at * {shards} div _at_all as int)")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_at") - F.expr(f"(shard * _at_all + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
