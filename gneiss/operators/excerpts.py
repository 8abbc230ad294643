"""Excerpts of evidence: bytes of files that are still the same, within fixed budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many excerpts, bytes of one, of all, and of the files behind them.
MOST, EACH, TOTAL, SOURCES = 512, 8 << 10, 2 << 20, 64 << 20
EXCERPTS = "evidence_id string, path string, start_line long, end_line long, text string, truncated boolean"


def excerpts(evidence: DataFrame, files: DataFrame, most: int = MOST, each: int = EACH, total: int = TOTAL, sources: int = SOURCES) -> DataFrame:
    """The first ``most`` spans by path and place whose file still has the hash of the evidence, each cut to the budgets at a character.

    A file that what is left of ``sources`` does not hold is passed over. What meets in one task are at most
    ``most`` rows with at most ``each`` bytes.
    """
    spans = evidence.orderBy("path", "start_byte", "end_byte", "id").limit(most)
    content = F.col("content").cast("binary")
    # at most ``most`` short rows: contents stay where they are read, and only those asked for go on
    read = files.select("path", "content", F.col("content_hash").alias("_hash")).join(F.broadcast(spans), "path").where(F.col("content").isNotNull() & (F.col("_hash") == F.col("content_hash")) & (F.sha2(content, 256) == F.col("content_hash")))
    size = F.octet_length(content).cast("long")
    fits = (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= size) & (F.col("start_byte") >= 0)
    cut = F.substring(content, (F.col("start_byte") + 1).cast("int"), F.least(F.col("end_byte") - F.col("start_byte"), F.lit(each)).cast("int"))
    rows = read.select("id", "path", "start_line", "end_line", "start_byte", "end_byte", size.alias("_size"), fits.alias("_fits"), F.when(fits, cut).alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held, seen, used, out = None, False, 0, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, held = r["path"], r["_size"] <= sources - seen
                    seen += r["_size"] if held else 0
                if not held or not r["_fits"] or used >= total:
                    continue
                text = _text(bytes(r["_bytes"][: total - used]))
                used += len(text.encode())
                out.append((r["id"], path, r["start_line"], r["end_line"], text, len(text.encode()) < r["end_byte"] - r["start_byte"]))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in EXCERPTS.split(", ")])

    # a shuffle of these rows alone: without one, all that is read before would be one task too
    return rows.repartition(1).sortWithinPartitions("path", "start_byte", "end_byte", "id").mapInArrow(run, EXCERPTS)


def _text(data: bytes) -> str:
    """The longest beginning that is whole characters."""
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        return data[: error.start].decode()
