"""Web archives, index first.

Pages are written as WARC/1.1 records, each a gzip member of its own, and the writer returns an index of offset, length,
URL and digest for every record. Readers start from the index: the wanted records are sorted by file and offset, ranges
that lie close are coalesced, and only these byte ranges are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch, written
from palimpsest.llm.files import opened, output, sized_slices

BATCH_BYTES = 8_000_000
#: Date of the records: none is known, and files should not differ between runs.
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str) -> str:
    return " ".join(text.split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit has the HTTP header of the page (its Content-Length is the payload's), but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, lower-cased, and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def urn_page(field: str) -> int | None:
    digits = field.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def roles(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, payload) with first_id, the page_id that holds the payload of equal ones.

    Only digests and ids are grouped; payloads meet the answer in a join by page_id.
    """
    digest = F.sha2("payload", 256)
    ids = written(pages.select("page_id", F.octet_length("payload").alias("n"), digest.alias("d")), "payload-digests")
    firsts = ids.where(F.col("n") >= least_bytes).groupBy("d", "n").agg(F.min("page_id").alias("first_id"), F.count("*").alias("k"))
    again = ids.join(firsts.where("k > 1"), ["d", "n"]).where("not page_id <=> first_id")
    again = again.select("page_id", "d", "first_id").distinct()
    p, a = pages.withColumn("d", digest).alias("p"), again.alias("a")
    same = F.col("p.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("p.d") == F.col("a.d"))
    return p.join(a, same, "left").select("p.page_id", "p.url", "p.payload", "a.first_id")


def write_warc(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    payload: str | Column = "html",
    least_bytes: int = 0,
) -> tuple[str, DataFrame]:
    """Folder of the archives, and their index. Of pages with equal payloads of least_bytes or more, the one with the
    smallest page_id is a response, the others revisit it."""
    text = F.col(payload) if isinstance(payload, str) else payload
    own = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(text.cast("binary"), F.lit(b"")).alias("payload"),
    )
    folder = scratch(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        name, at = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with output(folder, name) as out:
            index: list[tuple] = []

            def put(batch: pa.RecordBatch) -> None:
                nonlocal at
                for i, u, body, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = record(i, u, body, ref, ref is not None)
                    press = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member
                    packed = press.compress(raw) + press.flush()
                    out.write(packed)
                    kind = "response" if ref is None else "revisit"
                    index.append((name, at, len(packed), i, u, payload_digest(body), kind))
                    at += len(packed)

            def rows() -> pa.RecordBatch:
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                columns = zip(*index, strict=True)
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
                )

            for batch in sized_slices(first, "payload", BATCH_BYTES):
                put(batch)
            for whole in batches:
                for batch in sized_slices(whole, "payload", BATCH_BYTES):
                    put(batch)
                if len(index) >= 50_000:
                    yield rows()
                    index = []
        if index:
            yield rows()

    return folder, written(roles(own, least_bytes=least_bytes).mapInArrow(write, INDEX), "warc-index")


def coalesced(rows: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int]]:
    """Sorted (offset, length) ranges joined where less than `gap` bytes lie between, up to `most` bytes (a longer single
    range stays whole)."""
    out: list[tuple[int, int]] = []
    for offset, length in rows:
        if out and offset - sum(out[-1]) < gap and offset + length - out[-1][0] <= most:
            out[-1] = (out[-1][0], offset + length - out[-1][0])
        else:
            out.append((offset, length))
    return out


def read_records(
    folder: str, wanted: DataFrame, *, gap: int = 65_536, most: int = 8_000_000, slice_bytes: int = 64_000_000
) -> DataFrame:
    """file, offset, page_id, url, digest, record_type, refers_to, payload_bytes, payload of the wanted index rows, from
    the archives. payload is null for a revisit; all else of it comes from its own record.

    Index rows are dealt by file and slices of it, and sorted by offset there; a task holds one coalesced range. Every
    payload is checked against its digest.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for name, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                by_file.setdefault(name, []).append((offset, length))
            for name, rows in by_file.items():
                with opened(folder, name) as f:
                    spans, k = coalesced(rows, gap, most), 0
                    for begin, size in spans:
                        f.seek(begin)
                        raw, out = f.read(size), []
                        while k < len(rows) and rows[k][0] < begin + size:
                            at, length = rows[k][0] - begin, rows[k][1]
                            out.append((name, rows[k][0], *_record_row(zlib.decompress(raw[at : at + length], 31))))
                            k += 1
                        columns = zip(*out, strict=True)
                        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                            ["file", "offset", "page_id", "url", "digest", "record_type", "refers_to", "payload_bytes", "payload"],
                        )

    part = F.floor(F.col("offset") / slice_bytes)
    own = wanted.select("file", "offset", "length").withColumn("part", part)
    # index rows are so small that Spark would give them all to one task: the bytes behind them count
    slices = own.select("file", "part").distinct().count()
    placed = own.repartition(max(1, 2 * slices), "file", "part")
    return placed.sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(
        read,
        "file string, offset long, page_id long, url string, digest string, record_type string, refers_to long, "
        "payload_bytes long, payload binary",
    )


def _record_row(raw: bytes) -> tuple:
    fields, block = parse(raw)
    http, _, body = block.partition(b"\r\n\r\n")
    headers = dict(line.decode().lower().split(": ", 1) for line in http.split(b"\r\n")[1:])
    n, digest, kind = int(headers["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(body) != n or payload_digest(body) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    refers = fields.get("warc-refers-to")
    return (
        urn_page(fields["warc-record-id"]),
        fields["warc-target-uri"],
        digest,
        kind,
        urn_page(refers) if refers else None,
        n,
        body if kind == "response" else None,
    )


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages, from archives that are written
    and read again.

    A null html is an empty payload, and empty payloads are equal like others. Rows that repeat a page_id and payload are
    all responses if it is the smallest, else all revisits. A row with a null page_id revisits an equal page that has
    one, else it is a response; its own page_id comes back null. An empty table writes no archive and gives no rows. Only
    the named columns are read.
    """
    folder, index = write_warc(pages, **options)
    return read_records(folder, index).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
