"""Mixing sources to target weights by a low-discrepancy schedule.

Slots are numbered 0, 1, 2, ... Slot i has the point frac((i + 1/2) / golden
ratio), and the source whose cumulative target share covers it; a source with a
target that no point hits has one slot more, dealt in between. Slots are ranked
within their source. Each source's documents are shuffled by a seeded hash, laid
end to end as one stream of words that begins again after its end, and the first
words of that stream, as many as the target, are cut evenly over the source's
slots: a source has a block length of its own. So the slots of a source together
take its target to the word, whatever the corpus and the other sources.

Every slot of the schedule is laid over the documents that its words come from; a
document's taken words are the sum over those slots, and it enters the mixture at the
first of them. Slots and documents meet in cells of a stream as long as a slot on average,
so a document meets as many slots as it has words in, however long either is.

Edge cases: a null source is a source of its own and comes last; a null text has
size 0; documents of size 0 take nothing; repeated rows lie in the stream one by
one. If all sizes are 0 nothing is taken. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import bucket_of, clean_text, materialize, with_offsets, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST_REPEATS = 3
SLOTS = 65_536
#: More sources than this are refused: their table goes to the driver and to each executor.
MOST_SOURCES = 100_000
GOLDEN = (5**0.5 - 1) / 2
SEED = 8
BUCKETS = 2048


def targets(sizes: list[int], weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; none above ``most`` times its size, the excess reshared."""
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i % len(weights)] for i in sorted(free))
        share = {i: left * weights[i % len(weights)] / total for i in free}
        full = sorted(i for i in free if share[i] > most * sizes[i])
        if not full:
            for i in free:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free -= set(full)
    return out


def whole_targets(target: list[float]) -> list[int]:
    """Targets in whole words."""
    return [round(x) for x in target]


def schedule(target: list[float], slots: int = SLOTS) -> pd.DataFrame:
    """Slots in order with their point, source's number, rank, and the words of the source's endless stream: ``begin`` to ``end``."""
    whole = np.asarray(whole_targets(target), dtype=np.int64)
    n = min(slots, int(whole.sum()))
    points = np.modf((np.arange(n) + 0.5) * GOLDEN)[0]
    edges = np.cumsum(whole) / max(whole.sum(), 1)
    source = np.searchsorted(edges, points, side="right")
    missed = np.setdiff1d(np.flatnonzero(whole), source)
    between = np.modf((np.arange(len(missed)) + 0.5) * GOLDEN)[0]
    table = pd.DataFrame({"point": np.concatenate([points, (edges - whole / max(whole.sum(), 1) / 2)[missed]]), "sidx": np.concatenate([source, missed]).astype(np.int64)})
    table = table.iloc[np.argsort(np.concatenate([np.arange(n), between * n]), kind="stable")].reset_index(drop=True)
    table["rank"] = table.groupby("sidx").cumcount().astype(np.int64)
    count = table.groupby("sidx")["rank"].transform("size").to_numpy().astype(np.int64)
    words, rank = whole[table["sidx"].to_numpy()], table["rank"].to_numpy()
    for name, k in (("begin", rank), ("end", rank + 1)):
        table[name] = k * (words // np.maximum(count, 1)) + k * (words % np.maximum(count, 1)) // np.maximum(count, 1)
    table.insert(0, "slot", np.arange(len(table), dtype=np.int64))
    return table


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words of every row, written once; equal rows are numbered by ``_n``."""
    rows = docs.select("doc_id", "source", word_count(clean_text()).alias("size"))
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_n"))
    return materialize(counted.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))), "mixing")


def plan(rows: DataFrame) -> DataFrame:
    """The sources with number, size, target and the target in whole words."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["n"] or 0) for r in found]
    target = targets(sizes)
    return spark.createDataFrame(
        [(r["source"], i, *x) for i, (r, *x) in enumerate(zip(found, sizes, target, whole_targets(target), strict=True))],
        T.StructType([T.StructField("source", T.StringType()), T.StructField("sidx", T.LongType(), False), T.StructField("source_size", T.LongType(), False), T.StructField("target", T.DoubleType(), False), T.StructField("words", T.LongType(), False)]),
    )


def slots_of(sources: DataFrame) -> tuple[DataFrame, int]:
    """The schedule's slots with the cells of their source's stream that they lie in; and the words in a cell, a slot's on average."""
    table = schedule([r["target"] for r in sources.select("sidx", "target").orderBy("sidx").collect()])
    cell = max(1, -(-int((table["end"] - table["begin"]).sum()) // max(len(table), 1)))
    table = table.loc[table["end"] > table["begin"], ["slot", "sidx", "begin", "end"]].set_axis(["slot", "sidx", "_from", "_to"], axis=1)
    slots = sources.sparkSession.createDataFrame(pa.Table.from_pandas(table, preserve_index=False))
    return slots.withColumn("_cell", F.explode(F.expr(f"sequence(_from div {cell}, (_to - 1) div {cell})"))), cell


def sourced(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what is known of their source."""
    return rows.alias("d").join(F.broadcast(sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "sidx", "source_size", "target", "words")


def streams(rows: DataFrame, sources: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Rows with their source's number, the word of its stream at which they begin, and their bucket ``_b`` of it.

    ``_n``, where rows have it, tells rows of one doc_id and size apart, so that they fill no single bucket.
    """
    keyed = sourced(rows, sources)
    keyed = keyed if "_n" in keyed.columns else keyed.withColumn("_n", F.lit(1).cast("long"))
    keyed = keyed.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size", "_n")).withColumn("_b", bucket_of(F.col("_h"), buckets))
    return with_offsets(keyed, ["sidx"], "_b", ["_h", "doc_id", "size", "_n"], "size", "start").drop("_h", "_n", "start_all")


def pieces(placed: DataFrame, slots: DataFrame, cell: int) -> DataFrame:
    """A row for each round of a document, cell and slot in it; ``overlap`` counts the words that all share.

    A document of which no slot takes a word has rows without a slot.
    """
    copies = placed.withColumn("_round", F.explode(F.expr("sequence(0L, greatest(0L, (words - start - 1) div source_size))")))
    copies = copies.withColumn("_low", F.expr("start + _round * source_size")).withColumn("_high", F.expr("least(_low + size, words)"))
    cut = copies.withColumn("_cell", F.explode(F.expr(f"sequence(_low div {cell}, greatest(_low, _high - 1) div {cell})")))
    shared = F.expr(f"least(_high, _to, (_cell + 1) * {cell}) - greatest(_low, _from, _cell * {cell})")
    return cut.join(F.broadcast(slots), ["sidx", "_cell"], "left").withColumn("overlap", F.when(F.col("slot").isNull() | (shared < 0), 0).otherwise(shared))


def dealt(rows: DataFrame, sources: DataFrame, *by: str) -> DataFrame:
    """Sized rows that have words, with the words that the schedule's slots take of them and the first such slot; one row for each ``by``, such as its rounds."""
    slots, cell = slots_of(sources)
    placed = streams(rows.where("size > 0"), sources)
    found = pieces(placed, slots, cell).groupBy(*placed.columns, *by)  # rows of a bucket lie together, so this moves none
    return found.agg(F.sum("overlap").cast("long").alias("taken"), F.min(F.when(F.col("overlap") > 0, F.col("slot"))).alias("first_slot")).drop("_b", "sidx", "start", "words")


def taken_of(rows: DataFrame) -> DataFrame:
    """Sized rows with their source's size and target, the words that the schedule takes of them, and the first slot that takes one, or null."""
    sources = plan(rows)
    nothing = sourced(rows.where("size = 0"), sources).drop("_n", "sidx", "words")
    nothing = nothing.withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")})
    return dealt(rows, sources).unionByName(nothing)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken words and first slot of every row."""
    return taken_of(sized(docs))


def mixed_documents(docs: DataFrame, columns: list[str], slot: str | None = None) -> DataFrame:
    """The documents of the mixture: a copy for each round of a document of which the schedule's slots take at least half.

    A source's stream covers a document as a whole, once for each of its rounds, but for the one at
    which the target ends: so a source's words differ from its target by at most half of one
    document. Documents without words, which take no part in the mixture, stay once. Each row counts for
    itself, also where a doc_id is null or repeats. Null texts have no words; null sources are a
    source of their own. An empty table gives an empty result. A column named ``slot``, if
    given, has the slot at which a copy enters, or null without words: in its order, the mixture has its shares from the first documents on.
    """
    text = F.xxhash64("text")
    row = F.monotonically_increasing_id()
    held = docs.select(F.struct(*columns).alias("_doc"), "doc_id", "source", word_count(clean_text()).alias("size"), row.alias("_row"), F.when(F.col("doc_id").isNull(), F.xxhash64("text", row)).otherwise(text).alias("_n"))
    held = materialize(held, "mixing")  # numbers of rows hold only once they are written
    copies = dealt(held.drop("_doc"), plan(held), "_round").where("2 * taken >= size").select("_row", "first_slot")
    copies = copies.unionByName(held.where("size = 0").select("_row", F.lit(None).cast("long").alias("first_slot")))
    out = held.select("_row", "_doc").join(copies, "_row")
    return out.select("_doc.*", *([F.col("first_slot").alias(slot)] if slot else []))
