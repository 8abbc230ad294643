"""WARC: writing archives of gzip members, and a salvage reader.

Writer. Each record is a gzip member of its own. Of records with equal payloads
of at least ``REVISIT_BYTES`` bytes the one with the smallest page_id is a
response, the others are revisits without a block; smaller ones are all responses. A
task rolls over to a new file at ``ROLL_BYTES``; file names come from the task's
result, so that what a lost or repeated attempt left behind is never read.

Reader. A member or record that fails a check (inflation, CRC, header lines,
block length, payload digest) is not fatal: the reader searches for the next valid
member, or in uncompressed archives the next version line, goes on from there,
and logs the bytes in between as a gap with its reason.

Edge cases: a null html is an empty payload. Page ids that are null are written as such
and come back as null; among equal payloads a null id is never the
smallest unless all are null. Rows that repeat the smallest id are all
responses. An empty table gives no archive and an empty result. An archive that
holds nothing valid gives no record and one gap. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import shared_dir

REVISIT_BYTES = 100
ROLL_BYTES = 32 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")

RECORDS = "file string, at long, record_type string, page_id long, uri string, refers_to long, digest string, payload_bytes long, payload binary"
GAPS = "file string, start long, stop long, reason string"


# --- records ---------------------------------------------------------------


def record_bytes(page_id: int | None, uri: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", uri or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member, the same for the same bytes."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one may begin; ValueError if a check fails."""
    found = VERSION.match(data, at)
    if not found:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header without end")
    head = {}
    for line in data[found.end() : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        head[key.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not re.fullmatch(r"\d{1,12}", length):
        raise ValueError("no block length")
    start = end + 4
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("block length does not fit")
    payload, kind = data[start:stop], head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").rpartition(":")[2].lower()
    if kind == "response" and digest and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    return {
        "record_type": kind,
        "page_id": _number(head.get("warc-record-id")),
        "uri": head.get("warc-target-uri"),
        "refers_to": _number(head.get("warc-refers-to")),
        "digest": digest or hashlib.sha256(payload).hexdigest(),
        "payload_bytes": int(head["x-payload-length"]) if re.fullmatch(r"\d{1,18}", head.get("x-payload-length", "")) else len(payload),
        "payload": payload,
    }, stop + 4


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


# --- salvage ---------------------------------------------------------------


def salvage(data: bytes) -> Iterator[tuple[str, dict]]:
    """("record", fields) for each record that passes, ("gap", start, stop, reason) for what lies between.

    Both kinds of archive may be mixed in a file. What a member holds counts as
    damaged as a whole if no record in it passes; if some pass, the gap within
    the member is reported with the member's position.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(MAGIC, at):
                found, stop = _member_records(data, at)
            else:
                one, stop = parse_record(data, at)
                found = [one]
        except (ValueError, zlib.error) as error:
            if bad is None:
                bad, reason = at, str(error)
            at = _next_start(data, at + 1)
            continue
        if bad is not None:
            yield "gap", {"start": bad, "stop": at, "reason": reason}
            bad = None
        for x in found:
            if "reason" in x:
                yield "gap", {"start": at, "stop": stop, "reason": x["reason"]}
            else:
                yield "record", x | {"at": at}
        at = stop
    if bad is not None:
        yield "gap", {"start": bad, "stop": len(data), "reason": reason}


def _next_start(data: bytes, at: int) -> int:
    """The next position where a member or a version line may begin."""
    zipped = data.find(MAGIC, at)
    plain = VERSION.search(data, at, zipped if zipped >= 0 else len(data))
    return plain.start() if plain else zipped if zipped >= 0 else len(data)


def _member_records(data: bytes, at: int) -> tuple[list[dict], int]:
    inflate = zlib.decompressobj(31)
    view, parts, pos = memoryview(data), [], at
    while not inflate.eof:
        if pos >= len(data):
            raise ValueError("member is cut off")
        parts.append(inflate.decompress(view[pos : pos + (1 << 16)]))
        pos += 1 << 16
    stop = min(pos, len(data)) - len(inflate.unused_data)
    body, out, i, broken = b"".join(parts), [], 0, ""
    while i < len(body):
        try:
            one, i = parse_record(body, i)
            out.append(one)
        except ValueError as error:
            broken = broken or str(error)
            later = VERSION.search(body, i + 1)
            i = later.start() if later else len(body)
    if not out:
        raise ValueError(broken or "member without record")
    return out + ([{"reason": broken}] if broken else []), stop


# --- Spark -----------------------------------------------------------------


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def classified(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, uri, payload, digest, record_type and refers_to of every row."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("_first"))
    rows = rows.join(firsts, "digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first")


def write_archives(records: DataFrame, path: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write classified rows below ``path``; a row (file, records, bytes) for each archive."""

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, top = _open(path)
        system.create_dir(top, recursive=True)
        out, sink, size, n, files = [], None, 0, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if sink is None:
                    file = f"{name}-{files:04d}.warc.gz"
                    sink, size, n = system.open_output_stream(f"{top}/{file}", compression=None), 0, 0
                    files += 1
                data = member(record_bytes(r["page_id"], r["uri"], r["payload"], r["digest"], r["record_type"], r["refers_to"]))
                sink.write(data)
                size, n = size + len(data), n + 1
                if size >= roll:
                    sink.close()
                    out.append((f"{path}/{file}", n, size))
                    sink = None
        if sink is not None:
            sink.close()
            out.append((f"{path}/{file}", n, size))
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in out], "records": [x[1] for x in out], "bytes": [x[2] for x in out]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return records.mapInArrow(write, "file string, records long, bytes long")


def _salvaged(files: DataFrame, kind: str, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, top = _open(file)
                with system.open_input_stream(top, compression=None) as stream:
                    data = stream.read()
                rows, held = [], 0
                for what, x in salvage(data):
                    if what != kind:
                        continue
                    rows.append({"file": file} | x)
                    held += len(x.get("payload", b""))
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    assert names
    return files.select("file").mapInArrow(read, schema)


def read_archives(files: DataFrame) -> DataFrame:
    """All records that pass the checks, of archives listed in a column ``file``."""
    return _salvaged(files, "record", RECORDS)


def read_gaps(files: DataFrame) -> DataFrame:
    """The quarantined byte gaps of the archives."""
    return _salvaged(files, "gap", GAPS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder; the list of archives, kept as a table."""
    spark: SparkSession = pages.sparkSession
    top = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    listed = write_archives(classified(pages), f"{top}/archives")
    listed.write.parquet(f"{top}/manifest")
    return spark.read.schema("file string, records long, bytes long").parquet(f"{top}/manifest")
