"""WARC archives of pages through a table of payload chunks.

A payload is streamed as rows (record, chunk number) of bounded size, each with the digest of the payload up to its
end.  The first chunk of a record becomes a WARC response, each further one a continuation record with its segment
number, so no step after the first needs room for a whole payload.  Reading goes the same way: the archives come back
as a stream of short rows, and digests are carried on from segment to segment.

Archives are written and read by Spark's text source with the end of a record as line separator, which keeps bytes
as they are: any store that Spark writes to will do.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import byte_text, fresh_path, stored

CHUNK_BYTES = 1 << 20
RECORD_END = b"\r\n\r\n"
# Pages carry no time of capture; archives of the same pages are the same.
CAPTURED = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(payload: bytes, size: int) -> Iterator[tuple[int, bytes, str]]:
    """(chunk number, bytes, digest of the payload so far); an empty payload is one empty chunk."""
    digest = hashlib.sha1()
    view = memoryview(payload)
    for number, at in enumerate(range(0, len(payload), size) or (0,)):
        part = view[at : at + size]
        digest.update(part)
        yield number, bytes(part), base32(digest.digest())


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch.column(1).to_pylist()
        digests = pa.array([base32(hashlib.sha1(p).digest()) for p in payloads], pa.string())
        sizes = pa.array([len(p) for p in payloads], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), digests, sizes], ["id", "digest", "bytes"])


_CHUNKS = pa.schema(
    [("id", pa.int64()), ("uid", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()),
     ("chunk", pa.int32()), ("chunks", pa.int32()), ("running", pa.string()), ("data", pa.binary())]
)


def _chunk_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            rows: list[tuple] = []
            held = 0
            for i, uid, url, payload in zip(*columns, strict=True):
                count = max(1, -(-len(payload) // size))
                whole = base32(hashlib.sha1(payload).digest())
                for number, part, running in chunk_rows(payload, size):
                    rows.append((i, uid, url, whole, len(payload), number, count, running, part))
                    held += len(part)
                    if held >= 8 * size:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNKS, strict=True)], schema=_CHUNKS)


def chunk_table(pages: DataFrame, id_col: str, url_col: str, html_col: str, size: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk: id, uid (one per row of ``pages``), url, digest and bytes of the payload, chunk, chunks,
    running (digest up to this chunk's end), data."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(url_col).alias("url"),
        byte_text(html_col).alias("payload"),
    )
    return rows.mapInArrow(
        _chunk_batches(size),
        "id long, uid long, url string, digest string, bytes long, chunk int, chunks int, running string, data binary",
    )


def _name(column: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("none")), F.lit(">"))


def _line(field: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{field}: "), value, F.lit("\r\n")), F.lit(""))


def records(chunks: DataFrame) -> Column:
    """The bytes of a chunk's record, without the end of record; needs ``refers_to`` beside the chunk's columns."""
    first, last, revisit = F.col("chunk") == 0, F.col("chunk") == F.col("chunks") - 1, F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit("\r\n\r\n"),
    ).cast("binary")
    block = F.when(revisit, http).when(first, F.concat(http, F.col("data"))).otherwise(F.col("data"))
    several = (F.col("chunks") > 1) & ~revisit
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    # Addresses are one line whatever they hold.
    url = F.regexp_replace("url", r"[\r\n]+", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.when(first, _name(F.col("id"))).otherwise(F.concat(F.lit("<urn:page:"), F.col("uid").cast("string"), F.lit(":"), F.col("chunk").cast("string"), F.lit(">")))),
        _line("WARC-Date", F.lit(CAPTURED)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _line("WARC-Refers-To", F.when(revisit, _name(F.col("refers_to")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Segment-Number", F.when(several, (F.col("chunk") + 1).cast("string"))),
        _line("WARC-Segment-Origin-ID", F.when(several & ~first, _name(F.col("id")))),
        _line("WARC-Segment-Total-Length", F.when(several & last, (F.octet_length(http) + F.col("bytes")).cast("string"))),
        _line("X-Running-Digest", F.when(~revisit, F.concat(F.lit("sha1:"), F.col("running")))),
        _line("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), block)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Gzipped WARC files under ``path``, one per task.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the largest id is a response, the others
    are revisits of it.  Null payloads count as empty; rows that share the largest id, and rows of a payload that no
    id belongs to, are all responses; null addresses leave their header out.  An empty table gives no record.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), byte_text(html_col).alias("payload"))
    signed = stored(rows.mapInArrow(_digest_batches, "id long, digest string, bytes long"), "signed")
    equal = stored(
        signed.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("kept")), "equal"
    )
    # Equal digests and sizes; a group's rows meet its one answer, and a hot group's rows are split by the join.
    decided = stored(
        signed.join(equal, ["digest", "bytes"], "left")
        .select("id", "digest", F.when(~F.col("id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))
        .distinct(),
        "decided",
    ).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    chunks = chunk_table(pages, id_col, url_col, html_col, chunk_bytes)
    joined = chunks.join(
        decided.hint("merge"), chunks["id"].eqNullSafe(decided["_id"]) & (chunks["digest"] == decided["_digest"])
    ).where("refers_to is null or chunk = 0")
    ordered = joined.sortWithinPartitions("id", "uid", "chunk")
    ordered.select(records(ordered).cast("string").alias("value")).write.option("compression", "gzip").option(
        "lineSep", RECORD_END.decode()
    ).text(path)


class Reader:
    """Reads a stream of WARC bytes piece by piece and yields a row per finished record."""

    def __init__(self):
        self.buffer = b""
        self.left = 0  # bytes of the current block still to come
        self.fields: dict[str, str] | None = None
        self.open: dict | None = None  # the record whose segments are read

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while True:
            if self.fields is None:
                self.buffer = self.buffer.lstrip(b"\r\n")
                head, end, rest = self.buffer.partition(RECORD_END)
                if not end:
                    return
                first, *lines = head.decode("utf-8").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"no WARC record: {first[:80]!r}")
                self.fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
                self.left, self.buffer = int(self.fields["content-length"]), rest
                self._begin()
            part, self.buffer = self.buffer[: self.left], self.buffer[self.left :]
            self.left -= len(part)
            self._body(part)
            if self.left:
                return
            if (row := self._end()) is not None:
                yield row
            self.fields = None

    def _begin(self) -> None:
        fields = self.fields
        if fields["warc-type"] == "continuation":
            if self.open is None or self.open["name"] != fields["warc-segment-origin-id"] or self.open["segment"] + 1 != int(fields["warc-segment-number"]):
                raise ValueError(f"segment out of order: {fields}")
            self.open["segment"] += 1
            return
        self.open = {
            "name": fields["warc-record-id"], "type": fields["warc-type"], "segment": 1, "http": b"", "in_head": True,
            "digest": hashlib.sha1(), "bytes": 0, "declared": fields["warc-payload-digest"].removeprefix("sha1:"),
            "refers_to": fields.get("warc-refers-to"), "several": "warc-segment-number" in fields,
        }

    def _body(self, part: bytes) -> None:
        record = self.open
        if record["in_head"]:
            head, end, part = (record["http"] + part).partition(RECORD_END)
            if not end:
                record["http"] = head
                return
            lines = (line.partition(b": ") for line in head.split(b"\r\n")[1:])
            record["size"] = next(int(v) for k, _, v in lines if k.lower() == b"content-length")
            record["in_head"] = False
        record["digest"].update(part)
        record["bytes"] += len(part)

    def _end(self) -> tuple | None:
        record = self.open
        if record["type"] == "response":
            running = base32(record["digest"].digest())
            if running != self.fields["x-running-digest"].removeprefix("sha1:"):
                raise ValueError(f"damaged segment {record['segment']} of {record['name']}")
            if record["several"] and "warc-segment-total-length" not in self.fields:
                return None
            if running != record["declared"] or record["bytes"] != record["size"]:
                raise ValueError(f"damaged payload of {record['name']}")
        return (_number(record["name"]), record["size"], record["declared"], record["type"], _number(record["refers_to"]))


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return None if digits in ("", "none") else int(digits)


_READ = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64())]
)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        rows = [row for value in batch.column(0).to_pylist() for row in reader.feed(value + RECORD_END)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
    if reader.fields is not None:
        raise ValueError("the archive ends within a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records under ``path``.

    Gzipped files are not split, so a task reads whole files in order; size and digest of responses are computed from
    the bytes read and compared with what the headers say, those of revisits are the declared ones.
    """
    lines = spark.read.option("lineSep", RECORD_END.decode()).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(
        _read_batches, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the archives to the shared folder and reads them back; see the two functions above."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col, min_bytes, chunk_bytes)
    return read_archives(pages.sparkSession, path)
