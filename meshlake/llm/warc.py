"""WARC archives: writing with segmentation, and reading with segment reassembly.

A page is an HTTP response whose body has chunked transfer framing. A record
block longer than a segment is written as a first record and continuations
that name their origin, their number and, on the last, the total length.
Reading parses each archive once. It takes complete records as they are; the segments
of the others are grouped by origin, put in order, checked against the total length
and joined. What is broken comes back as a row with the reason, beside all that is whole.

Archives are plain WARC files, written and read by Spark's own readers and
writers, so any file system that Spark knows will do. Each is bounded in size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import cut, small_batches, table_path

#: Bytes of a record block in one segment, bytes of a chunk, and about as many payload bytes in one archive.
SEGMENT, CHUNK, ARCHIVE = 16 << 10, 4096, 16 << 20
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(payload):
    """Upper-case base32 of a binary column's SHA-1, from its hexadecimal form: 5 digits make 4 letters."""
    digits = F.sha1(payload)

    def letter(i):
        group = F.conv(F.substring(digits, (i.cast("int") / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        shift = (F.lit(3) - i % 4) * 5
        code = (group / F.pow(F.lit(2), shift)).cast("int") % 32
        return F.substring(F.lit(_ALPHABET), code + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a body."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out.append(b"%x\r\n%b\r\n" % (len(part), part))
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The body behind chunked framing; extensions and trailers are skipped. ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size line is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    if any(k.strip().lower() == b"transfer-encoding" and v.strip().lower() == b"chunked" for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])):
        return unchunked(body)
    return body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records_of(page_id: str, url: str, payload: bytes | None, size: int, digest: str, first: str | None, nth: int, segment: int = SEGMENT) -> list[bytes]:
    """The WARC records of a page, without the two line ends after each. ``first``: id of the response that a revisit refers to."""
    own = f"<urn:x-page:{page_id}:{digest}" + (f":{nth}>" if nth else ">")
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url)]
    if first is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  ("WARC-Refers-To", f"<urn:x-page:{first}:{digest}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
        return [_record(fields, b"")]
    block = _HTTP + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if len(block) <= segment:
        return [_record(fields, block)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [_record([*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}/{n}>"), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        out.append(_record([*more, ("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else more, part))
    return out


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], memoryview, str | None]]:
    """Headers (names in lower case), block and error of each record of an uncompressed WARC file, by Content-Length.

    Where no record can be read, the error says why, and reading goes on at the next line that may begin one.
    """
    at, view = 0, memoryview(archive)
    while at < len(archive):
        if archive[at : at + 2] == b"\r\n":
            at += 2
            continue
        end, error, size, head = archive.find(b"\r\n\r\n", at), None, 0, {}
        if end < 0 or archive[at : at + 5] != b"WARC/":
            error = f"no WARC record at byte {at}"
        else:
            lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            number = head.get("content-length", "")
            if not (number.isascii() and number.isdigit()):
                error = f"no length of the record at byte {at}"
            elif end + 4 + int(number) > len(archive):
                error = f"the record at byte {at} is cut short"
            else:
                size = int(number)
        if error:
            yield head, view[:0], error
            at = archive.find(b"\r\nWARC/", at + 1)
            if at < 0:
                return
            continue
        yield head, view[end + 4 : end + 4 + size], None
        at = end + 4 + size


def _keys(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("number"), url.alias("url"), payload.alias("payload"))
    return rows.withColumns({"digest": base32_sha1(F.col("payload")), "sha": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload").cast("long")})


#: What makes two rows the same page with the same payload.
_SAME = ("number", "sha", "size")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The record of each page: ``page_id, url, digest, size, payload, first, nth``; revisits name the ``first`` page and have no payload.

    Of pages with equal payloads (by SHA-256 and length) of at least ``min_bytes``, the smallest page_id (null
    last) is the response, the others revisit it. Of rows that repeat a page_id and payload, one is
    the response; ``nth`` tells them apart. All is decided on narrow rows without payloads; payloads only
    meet the keys of pages that are no response, and are moved only if these are too many to send round.
    """
    rows = _keys(pages)
    # A table: the numbers of its rows can't change between two reads.
    keys = cut(rows.select(*_SAME, "url", "digest").withColumn("uid", F.monotonically_increasing_id()), "keys")
    best = F.min(F.struct(F.col("number").isNull().alias("missing"), "number", "url", "uid")).alias("best")
    shared = keys.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(best, F.count("*").alias("n")).where("n > 1")
    shared = cut(shared.select("sha", "size", F.col("best.number").alias("first"), F.col("best.uid").alias("first_uid")), "shared")
    copies = keys.join(shared, ["sha", "size"]).where("uid <> first_uid")
    copies = cut(copies, "copies")
    # A copy may have its response's page_id: of the payloads with their key, one is then taken.
    twin = F.col("number").eqNullSafe(F.col("first"))

    def matches(right: DataFrame):
        same = F.lit(True)
        for c in _SAME:
            same &= F.col(c).eqNullSafe(right[f"{c}_r"])
        return same

    def renamed(df: DataFrame, label: str) -> DataFrame:
        return cut(df.select(*[F.col(c).alias(f"{c}_r") for c in _SAME]).distinct(), label)

    page_id = F.col("number").cast("string").alias("page_id")
    none = F.lit(None).cast("string").alias("first")
    # Records that no other refers to are told apart by a number of their own.
    nth = F.when(F.col("size") < min_bytes, F.monotonically_increasing_id() + 1).otherwise(0).alias("nth")
    dropped, twins = renamed(copies, "dropped"), renamed(copies.where(twin), "twins")
    out = rows.join(dropped, matches(dropped), "left_anti").select(page_id, "url", "digest", "size", "payload", none, nth)
    if twins.limit(1).count():
        one = rows.join(twins, matches(twins), "left_semi").groupBy(*_SAME, "digest").agg(F.min("url").alias("url"), F.max("payload").alias("payload"))
        out = out.unionByName(one.select(page_id, "url", "digest", "size", "payload", none, F.lit(0).cast("long").alias("nth")))
    return out.unionByName(
        copies.select(page_id, "url", "digest", "size", F.lit(None).cast("binary").alias("payload"), F.coalesce(F.col("first").cast("string"), F.lit("null")).alias("first"), (F.col("uid") + 1).alias("nth"))
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write a record for each row of ``pages(page_id, url, html, ...)`` as WARC files below ``path``."""
    import pyarrow as pa

    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, digest, size, payload, first, nth = row
                out += records_of("null" if page_id is None else page_id, " ".join(url.split()), payload, size, digest, first, nth, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = plan_records(pages, min_bytes).select("page_id", "url", "digest", "size", "payload", "first", "nth").mapInArrow(run, "record binary")
    # The text writer puts bytes as they are; the line end that it adds closes a record.
    files = rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n")
    files.option("maxRecordsPerFile", max(1, ARCHIVE // segment)).text(path)


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """``record_id, kind, refers_to, digest, payload_bytes, payload, error`` of each response and revisit below ``path``.

    A revisit has no payload; its length is that of the payload it refers to. Without ``payloads`` that column is null
    throughout: payloads are decoded and checked, but not moved. Records that can't be read, whose
    segments are missing or repeated, or whose lengths, digests or framing don't hold are rows of kind
    "broken": ``error`` says why, and ``record_id`` which, if it is known. Other types of records are skipped.
    """
    import pyarrow as pa

    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    text, number, raw = pa.string(), pa.int64(), pa.binary()

    def response(record_id: str, digest: str, block: bytes) -> tuple:
        try:
            payload = payload_of(block)
        except ValueError as e:
            return record_id, "broken", None, None, None, None, str(e)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            return record_id, "broken", None, None, None, None, "the payload isn't what its digest says"
        return record_id, "response", None, digest, len(payload), payload if payloads else None, None

    def record(head: dict[str, str], block: memoryview, error: str | None) -> tuple | None:
        """A row: what is complete or broken, with null segment; or a segment, with its block as the payload and the total length as the length."""
        own, kind, digest = head.get("warc-record-id"), head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        try:
            if error:
                raise ValueError(error)
            if kind == "revisit":
                return own, kind, head["warc-refers-to"], digest, int(head["x-payload-length"]), None, None, None
            if "warc-segment-number" in head:
                total = head.get("warc-segment-total-length")
                return head.get("warc-segment-origin-id", own), "segment", None, digest, int(total) if total else None, bytes(block), None, int(head["warc-segment-number"])
            if kind == "response":
                return *response(own, digest, bytes(block)), None
        except (KeyError, ValueError) as e:
            return own, "broken", None, None, None, None, f"no {e.args[0]}" if isinstance(e, KeyError) else str(e), None
        return None

    names = ["record_id", "kind", "refers_to", "digest", "payload_bytes", "payload", "error"]
    types = [text, text, text, text, number, raw, text]

    def arrow(rows: list[tuple], segment: bool) -> pa.RecordBatch:
        kinds = [*types, number] if segment else types
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[*names, "segment"] if segment else names)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for found in parse(content.as_py()):
                    row = record(*found)
                    if row is None:
                        continue
                    rows.append(row)
                    size += len(row[5] or b"") + 200
                    if size >= 4 << 20:
                        yield arrow(rows, True)
                        rows, size = [], 0
        if rows:
            yield arrow(rows, True)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [x for x in group if x["segment"] is not None]
                rows += [(own, *(x[c] for c in names[1:])) for x in group if x["segment"] is None]
                if not parts:
                    continue
                numbers, total, digest = [x["segment"] for x in parts], max((x["payload_bytes"] or 0 for x in parts), default=0), parts[0]["digest"]
                block = b"".join(x["payload"] for x in parts)
                if numbers != list(range(1, len(numbers) + 1)) or total != len(block) or digest is None:
                    rows.append((own, "broken", None, None, None, None, f"segments {numbers[:100]} of {len(block)} bytes, {total} expected"))
                else:
                    rows.append(response(own, digest, block))
            yield arrow(rows, False)

    schema = "record_id string, kind string, refers_to string, digest string, payload_bytes bigint, payload binary, error string"
    rows = files.mapInArrow(parsed, f"{schema}, segment bigint")
    # One pass over the archives: what is complete goes through the grouping as small rows of their own, unless payloads are asked for.
    own = F.struct("segment", *names[1:])
    alone = F.when(F.col("segment").isNull(), F.monotonically_increasing_id())
    groups = rows.groupBy("record_id", alone.alias("alone")).agg(F.array_sort(F.collect_list(own)).alias("parts"))
    return groups.select("record_id", "parts").mapInArrow(joined, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html, ...)`` to archives in the shared folder and read them back.

    One row per row: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Null
    html is an empty payload, null url an empty one. Null page_ids come after all others. Rows
    that repeat a page are revisits of it. An empty table gives no rows; other columns aren't read.
    Fails if a record can't be read back. The archives go when ``drop_tables`` is called or the driver ends.
    """
    spark = pages.sparkSession
    path = table_path(spark, "warc")
    write_archives(pages, path, min_bytes)

    def page(urn):
        return F.regexp_extract(urn, r"^<urn:x-page:(-?[0-9]+|null):", 1).try_cast("long")

    back = read_archives(spark, path, payloads=False)
    whole = F.when(F.col("error").isNull(), F.col("kind")).otherwise(F.raise_error(F.concat_ws(": ", F.lit("a record can't be read back"), "record_id", "error")))
    return back.select(
        page(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        whole.cast("string").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"),
    )
