"""WARC archives: written with Spark's text sink, read back by a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from marketloom.session import materialize, temp_path

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload from which equal payloads are stored once, and bytes of an archive file at most (more only if one record has more).
MIN_BYTES, FILE_BYTES = 0, 16 << 20
#: Records are written apart by size, each class up to 16 times the bytes of the one before; bytes that headers add at most.
CLASS_BITS, FIRST_BITS, ADDED = 4, 12, 2048
#: Bytes in which a record's headers mostly end; bytes of a gzip member that are inflated at a time, and inflated bytes that are parsed at once.
HEAD_BYTES, BLOCK, PARSED = 1 << 16, 1 << 16, 4 << 20
#: Rows and payload bytes of a batch that leaves the reader.
ROWS, BATCH_BYTES = 1000, 8 << 20
RECORD_END = b"\r\n\r\n"
VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")


def digest32(binary) -> F.Column:
    """Bare upper-case base32 of a binary column's SHA-1, by five hex digits at a time."""
    hexed = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def size_class(size) -> F.Column:
    """0 up to 4 KB, and one more for each 16 times of it."""
    return F.greatest(F.lit(0), F.ceil((F.length(F.bin(size)) - FIRST_BITS) / CLASS_BITS)).cast("int")


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to for each page.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is a response and others revisit it. Null html is an empty
    payload; a null page_id is never referred to and stays a response; rows that repeat the smallest page_id are all responses.
    Other columns are ignored, whatever their names; html of any length is taken whole; an empty table gives an empty one. Groups meet in a minimum per digest; only digests with more than one page are joined, from a table, so a hot one is split.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", digest32(F.col("payload")))
    heads = base.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = materialize(heads.where("n > 1").drop("n"), "heads")
    out = base.join(heads, "payload_digest", "left")
    again = (F.col("payload_bytes") >= min_bytes) & (F.col("page_id") > F.col("head"))
    refers = F.when(again, F.col("head"))
    kind = F.when(refers.isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    return out.select("page_id", "url", "payload", "payload_bytes", "payload_digest", kind.alias("record_type"), refers.alias("refers_to"))


def _stored(html, url) -> F.Column:
    """Bytes of a page that its record may hold, without headers."""
    return F.octet_length(F.coalesce(html.cast("string"), F.lit(""))) + F.octet_length(F.coalesce(url.cast("string"), F.lit("")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record per page to plain WARC files under ``path``.

    A record is a row of text: headers, HTTP headers that state the payload's size, and the payload (none in a revisit); the line
    separator of the sink is what ends a record. So writing is atomic by task, and works wherever Spark writes. White space and
    control characters of a URL are dropped, as a header must not hold them. Records of a size class share files, so a file holds
    ``file_bytes`` at most, or one record of more.
    """
    records = plan_records(pages, min_bytes)
    crlf, payload = F.lit("\r\n"), F.col("payload").cast("string")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("record_type") == "response", F.concat(http, payload)).otherwise(http)
    head = F.concat_ws(
        "\r\n", F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]+", "")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))), F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    text = records.withColumn("block", block).select(size_class(_stored(payload, F.col("url"))).alias("class"), F.concat(head, crlf, crlf, F.col("block")).alias("value"))
    stored = _stored(F.col("html"), F.col("url"))
    sizes = pages.groupBy(size_class(stored).alias("class")).agg(F.max(stored).alias("most")).orderBy("class").collect()
    for r in sizes or [{"class": 0, "most": 0}]:
        own = text.where(F.col("class") == r["class"]).select("value")
        own.write.mode("append").option("lineSep", RECORD_END.decode()).option("maxRecordsPerFile", max(1, file_bytes // (r["most"] + ADDED))).text(path)


def _headers(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d\.\d", lines[0]) or any(":" not in x or re.search(r"[\x00-\x08\x0A-\x1F\x7F]", x) for x in lines[1:]):
        return None
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return found if re.fullmatch(r"<[^<>\s]+>", found.get("warc-record-id", "")) and found.get("warc-type") and found.get("warc-date") else None


def _record(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record at ``at`` with the place after it, or None if a check fails: headers, length, end mark, digest."""
    stop = data.find(RECORD_END, at, at + HEAD_BYTES)
    if stop < 0:  # a long URL: headers end before the next record begins
        after = VERSION_LINE.search(data, at + 1)
        stop = data.find(RECORD_END, at, after.start() if after else len(data))
    if stop < 0 or (h := _headers(data[at:stop])) is None or not (h.get("content-length") or "").isdigit():
        return None
    begin, end = stop + 4, stop + 4 + int(h["content-length"])
    if data[end : end + 4] != RECORD_END:
        return None
    http, split, body = data[begin:end].partition(RECORD_END)
    size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", b"\r\n" + http)
    size = int(size[1]) if size else len(body)
    kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (not split or size != len(body) or digest and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        return None
    page, refers = (re.fullmatch(r"<urn:page:(-?\d+)>", h.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    return {
        "page_id": int(page[1]) if page else None, "url": h.get("warc-target-uri"), "record_type": kind, "payload_digest": digest or None, "payload_bytes": size,
        "refers_to": int(refers[1]) if refers else None, "payload": body if kind == "response" else None, "error": None,
    }, end + 4


def _inflate(data: bytes, at: int):
    """(place, bytes) of the gzip member at ``at``, block by block: what came out of the bytes before ``place``. Ends with
    (place after the member, None), or (place of the damage, b"") where it is cut off or damaged."""
    inflate, size = zlib.decompressobj(31), BLOCK
    while not inflate.eof and at < len(data):
        before, block = inflate.copy(), data[at : at + size]
        try:
            out = inflate.decompress(block)
        except zlib.error:
            if size == 1:
                break
            inflate, size = before, max(1, size // 16)  # what stands before the damage comes out
            continue
        at += len(block) - len(inflate.unused_data)
        yield at, out
    yield at, None if inflate.eof else b""


def _member(data: bytes, start: int):
    """(start, end, record) of the records and gaps of the gzip member at ``start``, then (start, end, whether it is whole).

    Inflated bytes are parsed as they come and dropped once parsed, so memory follows the longest record, not the member. Records
    have the member's own place; what damage leaves unread is a gap from the block in which the last whole record ends.
    """
    held, seen, edge, good, places = bytearray(), 0, PARSED, start, []
    for at, out in _inflate(data, start):
        if out:
            held += out
            places.append((seen + len(held), at))
            if len(held) < edge:
                continue
        found, done = list(salvage(bytes(held), nested=False)), len(held)
        if found and found[-1][2] is None and out is not None:
            done = found.pop()[0]  # may be the beginning of a record that is still to come
        for *_, r in found:
            yield start, at, r
        good = max((p for n, p in places if n <= seen + done), default=good)
        places = [(n, p) for n, p in places if n > seen + done]
        seen, edge = seen + done, max(PARSED, 2 * (len(held) - done))
        del held[:done]
    yield (start, at, True) if out is None else (start, max(good, start + 1), False)


def salvage(data: bytes, base: int = 0, nested: bool = True):
    """(start, end, record) of each valid record, and (start, end, None) of each gap that no record could be read from.

    Plain records and gzip members may alternate. After a failed check the search goes on at the next version line or gzip
    member from which a whole valid record can be read. Of a damaged or cut-off member the records before the damage are kept, the
    rest of it is a gap; a member that inflates but holds damaged records is salvaged inside.
    """
    at = gap = 0
    mark = re.compile(VERSION_LINE.pattern + rb"|\x1f\x8b\x08") if nested else VERSION_LINE
    while m := mark.search(data, at):
        begin = at = m.start()
        if data.startswith(b"\x1f\x8b", begin):
            inside, some = [], False
            for a, b, r in _member(data, begin):
                if isinstance(r, bool):
                    at, gap = b, b if some else gap
                    continue
                if r and not some and gap < begin:
                    yield base + gap, base + begin, None
                some, inside = some or bool(r), [*inside, (base + a, base + b, r)]
                if some:  # a gap counts for itself only beside a record of its member
                    yield from inside
                    inside = []
        elif got := _record(data, begin):
            if gap < begin:
                yield base + gap, base + begin, None
            at = gap = got[1]
            yield base + begin, base + at, got[0]
        else:
            at += 1
    if gap < len(data):
        yield base + gap, base + len(data), None


RECORD = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
])


def read_archives(spark: SparkSession, path: str, payloads: bool = True, names: str | None = None) -> DataFrame:
    """A row per record, and a row with ``error`` set per quarantined gap; ``at`` and ``bytes`` say where in ``file``.

    All files under ``path`` are read, but for those whose names start with a dot or an underscore, which Spark leaves out; ``names``
    is a pattern to read fewer. What a file holds decides how it is read, not its name. A task holds a file, of 2 GB at most."""

    def run(batches):
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                rows, size = [], 0
                for a, b, r in salvage(content.as_py()):
                    rows.append({"file": name.as_py(), "at": a, "bytes": b - a} | (r or {"error": "no valid record"}) | ({} if payloads else {"payload": None}))
                    size += len(rows[-1].get("payload") or b"")
                    if len(rows) == ROWS or size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    files = spark.read.format("binaryFile")
    files = (files.option("pathGlobFilter", names) if names else files).load(path).select("path", "content")
    return files.mapInArrow(run, from_arrow_schema(RECORD))


def round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes ``pages`` and reads the records back, without payloads."""
    path = path or temp_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path, payloads=False)


def op3_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    back = round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.where("error IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sql() -> str:
    return f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
    m AS (SELECT h, min(page_id) AS head FROM d WHERE payload_bytes >= {MIN_BYTES} GROUP BY h)
    SELECT page_id, payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', (((('0x' || substr(d.h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
      CASE WHEN page_id > head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > head THEN head END AS refers_to
    FROM d LEFT JOIN m USING (h)
    """


QUERIES = {"op3_warc_round_trip": op3_warc_round_trip}
SQL = {"op3_warc_round_trip": op3_sql()}
