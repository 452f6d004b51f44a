"""WARC: pages as archive records, written and read by Spark, with segments reassembled.

Writing: one record per page.  The content block is an HTTP response with the payload in
chunked transfer framing.  A block longer than ``segment_bytes`` becomes a first record
(``WARC-Segment-Number: 1``) and ``continuation`` records that name it in
``WARC-Segment-Origin-ID``; the last one states the total length.  Of pages with equal
payloads of ``revisit_bytes`` or more, that with the smallest id is a ``response``, the
others are ``revisit`` records without payload.  Files are plain text output of Spark whose
line separator is the end of a WARC record, compressed as archives usually are; uncompressed
files can be read in splits.

Reading takes archives of any ``WARC/1.x``, compressed as one stream or one member per record.
Files are cut where a record may begin, and each task puts the pieces together in their order
by ``Content-Length``, so a payload may hold such a mark.  Continuation records are grouped by
origin, ordered by segment number and checked against the total length, and the chunked framing
is decoded.  A record whose length, framing or head does not fit, in one of its segments or as a
whole, is reported once in ``error`` and has no payload.  Uncompressed files are read in splits; there, a mark in a payload that begins a
split ends in an error, which the writer rules out by starting a new chunk inside any
``WARC/1.1`` of a payload.

Defined cases: a null payload is empty; pages of one id and payload are all responses if the
id is the smallest; a null id is never the smallest, and null if it is the only one; repeated
segments count once; an empty table gives an archive without records; other columns are
ignored; line breaks in an address are percent-encoded.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERSION, END, MARK = "WARC/1.1", "\r\n\r\n", "\r\n\r\nWARC/1.1\r\n"
ANY = "WARC/1."
CHUNK_BYTES, SEGMENT_BYTES, REVISIT_BYTES = 16 << 10, 64 << 10, 100
PIECE = (
    "id string, type string, page_id long, url string, refers_to long, digest string, segment int, "
    "origin string, total long, size long, block binary, fault string"
)
RECORD = (
    "id string, type string, page_id long, url string, refers_to long, digest string, "
    "full_length long, payload binary, error string"
)


def _cut(value: Column, size: int) -> Column:
    """A binary value in pieces of ``size`` bytes, at least one."""
    n = F.greatest(F.ceil(F.octet_length(value) / size).cast("int"), F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.substring(value, i * size + 1, F.lit(size))
    )


def chunked(payload: Column) -> Column:
    """Text in chunked transfer framing, as binary."""
    pieces = F.when(
        F.contains(payload, F.lit(VERSION)), F.split(payload, r"(?<=WA)(?=RC/1\.1)")
    ).otherwise(F.array(payload))
    chunks = F.flatten(F.transform(pieces, lambda p: _cut(p.cast("binary"), CHUNK_BYTES)))
    framed = F.transform(
        F.filter(chunks, lambda c: F.octet_length(c) > 0),
        lambda c: F.concat(F.hex(F.octet_length(c)).cast("binary"), F.lit(b"\r\n"), c, F.lit(b"\r\n")),
    )
    whole = F.aggregate(framed, F.lit(b""), lambda acc, c: F.concat(acc, c))
    return F.concat(whole, F.lit(b"0\r\n\r\n"))


def with_revisits(
    pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = REVISIT_BYTES
) -> DataFrame:
    """``_key``, ``_url``, ``_payload``, ``_digest``, ``_first``: the id a revisit refers to."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("_key"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"),
        body.alias("_payload"),
        F.sha2(body.cast("binary"), 256).alias("_digest"),
    )
    # only the digests of several pages are joined: a row each, made before the shuffle
    again = (
        rows.where(F.octet_length("_payload") >= least)
        .groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_first"))
        .where("_n > 1")
        .drop("_n")
    )
    revisits = F.when(~F.col("_key").eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.join(again, "_digest", "left").withColumn("_first", revisits)


def _head(*lines: Column) -> Column:
    """Header lines; a null one is left out."""
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines), F.lit(END))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def write_warc(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    payload: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    date: str = "2024-01-01T00:00:00Z",
    compression: str = "gzip",
) -> None:
    """Archive files below ``path``, one record or run of segments per page.

    Compressed files are read whole, one task each; a file is what one task wrote.
    """
    rows = with_revisits(pages, key, payload).withColumn("_row", F.monotonically_increasing_id())
    revisit = F.col("_first").isNotNull()
    length = F.octet_length("_payload")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(revisit, F.concat(F.lit("Content-Length: "), length.cast("string"))).otherwise(
            F.lit("Transfer-Encoding: chunked")
        ),
        F.lit(END),
    )
    block = F.concat(
        http.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(chunked(F.col("_payload")))
    )
    blocks = rows.select(
        "_key", "_url", "_digest", "_first", "_row", revisit.alias("_revisit"), block.alias("_block")
    )
    parts = blocks.select(
        "*", F.octet_length("_block").alias("_total"), F.posexplode(_cut(F.col("_block"), segment_bytes)).alias("_at", "_part")
    )
    page = F.coalesce(F.col("_key").cast("string"), F.lit("-"))
    name = lambda at: F.concat(F.lit("<urn:page:"), page, F.lit("/"), F.col("_row").cast("string"), at, F.lit(">"))
    at, many = F.col("_at"), F.col("_total") > segment_bytes
    last = many & ((at + 1) * segment_bytes >= F.col("_total"))
    url = F.replace(F.replace(F.col("_url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    first = at == 0
    header = _head(
        _line("WARC-Type", F.when(~first, "continuation").when(F.col("_revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.when(first, "").otherwise(F.concat(F.lit("/"), (at + 1).cast("string"))))),
        F.lit(f"WARC-Date: {date}"),
        F.when(first, _line("WARC-Target-URI", url)),
        F.when(first & F.col("_key").isNotNull(), _line("WARC-Page-ID", F.col("_key"))),
        F.when(first, _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest")))),
        F.when(first, _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">")))),
        F.when(first & F.col("_revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.when(many, _line("WARC-Segment-Number", at + 1)),
        F.when(~first, _line("WARC-Segment-Origin-ID", name(F.lit("")))),
        F.when(last, _line("WARC-Segment-Total-Length", F.col("_total"))),
        _line("Content-Length", F.octet_length("_part")),
    )
    record = F.concat(header.cast("binary"), F.col("_part")).cast("string").alias("value")
    parts.select(record).write.option("lineSep", END).option("compression", compression).text(path)


def _record(data: bytes) -> tuple[dict[bytes, bytes], bytes, int | None]:
    """Fields, what follows the head, and the length of the block; ``data`` behind ``WARC/1.``."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    size = fields.get(b"content-length", b"")
    known = size.isdigit() and b"warc-type" in fields
    return fields, body, int(size) if known else None


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the pieces of files, which come in their order within a file."""
    rows: list[tuple] = []
    open_: list[bytes] = []  # a record that is not complete yet
    missing = 0

    def add(data: bytes, fault: str | None = None) -> None:
        fields, body, size = _record(data)
        if fault is None and size is None:
            fault = "no record head"
        elif fault is None and body[size:].strip(b"\r\n"):
            fault = f"length {len(body)} of {size}"
        text = lambda name: fields[name].decode("utf-8", "replace") if fields.get(name) else None
        number = lambda value: int(value) if value and re.fullmatch(r"-?[0-9]{1,18}", value) else None
        refers = re.fullmatch(r"<urn:page:(-?[0-9]{1,18})>", text(b"warc-refers-to") or "")
        rows.append((
            text(b"warc-record-id"), text(b"warc-type"), number(text(b"warc-page-id")), text(b"warc-target-uri"),
            refers and int(refers[1]), (text(b"warc-payload-digest") or "").rpartition(":")[2],
            number(text(b"warc-segment-number")), text(b"warc-segment-origin-id"),
            number(text(b"warc-segment-total-length")), size, body[:size] if fault is None else None, fault,
        ))

    def given_up() -> None:
        if open_:
            add(b"".join(open_), f"{missing} bytes missing")
            open_.clear()

    def done() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(),
                 pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        names = [field.split()[0] for field in PIECE.split(", ")]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    start = ANY.encode()
    for batch in batches:
        for value in batch.column(0):
            data = value.as_buffer().to_pybytes()
            if data.startswith(start):  # the first record of a file
                given_up()
                data = data[len(start) :]
            if open_:
                open_.append(END.encode() + start + data)
                missing -= len(open_[-1])
            elif not data.strip(b"\r\n"):
                continue
            else:
                _, body, size = _record(data)
                if size is not None and len(body) < size:
                    open_.append(data)
                    missing = size - len(body)
                else:
                    add(data)
            if open_ and missing <= 0:
                add(b"".join(open_))
                open_.clear()
        if rows:
            yield done()
    given_up()
    if rows:
        yield done()


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The payload of each content block, without its HTTP head and framing."""
    for batch in batches:
        payloads, errors, lengths = [], [], []
        given = (batch.column(n) for n in ("block", "total", "fault"))
        for block, total, error in zip(*(c if i == 0 else c.to_pylist() for i, c in enumerate(given)), strict=True):
            data = block.as_buffer().to_pybytes() if error is None else b""
            payload, length = None, None
            head, found, body = data.partition(b"\r\n\r\n")
            if error is not None:
                pass
            elif total is not None and total != len(data):
                error = f"length {len(data)} of {total}"
            elif not found:
                error = "no HTTP head"
            else:
                fields = {
                    k.strip().lower(): v.strip()
                    for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])
                }
                try:
                    payload = body
                    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
                        payload = unchunk(body)
                    elif fields.get(b"content-length", b"").isdigit():
                        length = int(fields[b"content-length"])
                except ValueError as e:
                    payload, error = None, f"chunks: {e}"
            payloads.append(payload)
            errors.append(error)
            lengths.append(length)
        kept = [n for n in batch.schema.names if n not in ("block", "total", "fault")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), pa.array(lengths, pa.int64()), pa.array(payloads, pa.binary()), pa.array(errors, pa.string())],
            names=[*kept, "full_length", "payload", "error"],
        )


def unchunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError if it is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("no size line")
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        start, at = line + 2, line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk of another size")
        parts.append(body[start:at])
        at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of the archives below ``path``, columns as in ``RECORD``."""
    lines = spark.read.option("lineSep", END + ANY).text(path)
    records = lines.select(F.col("value").cast("binary")).mapInArrow(_pieces, PIECE)
    plain = ["id", "type", "page_id", "url", "refers_to", "digest"]
    kinds = F.col("fault").isNotNull() | F.col("type").isin("response", "revisit")
    whole = records.where(F.col("segment").isNull() & kinds)
    whole = whole.select(*plain, F.col("size").alias("total"), "block", "fault")
    # grouped by the record the segments belong to: no group is larger than one record
    parts = records.where(F.col("segment").isNotNull())
    joined = parts.groupBy(F.coalesce("origin", "id").alias("_origin")).agg(
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("segments"),
        F.max("total").alias("total"),
        F.max("fault").alias("fault"),
        *[F.max(F.when(F.col("segment") == 1, F.col(n))).alias(n) for n in plain],
    )
    block = F.aggregate(F.col("segments.block"), F.lit(b""), lambda acc, b: F.concat(acc, b))
    # without the last segment there is no total, which no block has
    joined = joined.select(*plain, F.coalesce("total", F.lit(-1)).alias("total"), block.alias("block"), "fault")
    return whole.unionByName(joined).mapInArrow(_decode, RECORD)
