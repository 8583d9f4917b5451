"""WARC archives: write records, read them back, resolve revisits, write deduplicated archives.

Spark's text writer writes archives: a record's end, two line ends, is its line separator. Files are split
by a number of records that depends on their size, so that no archive holds more than a bounded number of bytes or one
record. Reading takes each file's bytes and cuts records by their Content-Length, so that payloads may hold
anything. To resolve revisits only headers are shuffled, by payload digest; the payloads meet their decision in
a broadcast of the revisits, or in a join if there are too many of them. What a capture's own headers say (date, HTTP
status and headers, other WARC fields of records that aren't rewritten) is kept.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.session import count, materialize, scratch_path

DATE = "2024-01-01T00:00:00Z"
#: Records in one archive file, and bytes: records of up to SMALL bytes are RECORDS to a file, those of up to
#: 4, 16, ... times that so many times fewer.
RECORDS, SMALL = 4096, 1 << 14
#: Digests and revisits broadcast to their records, about 100 bytes each.
BROADCAST_REVISITS = 500_000
#: Bytes inflated at a time.
STEP = 1 << 16

HEADERS = (
    "record_id string, page_id long, uri string, digest string, payload_bytes long, kind string, refers_to_id string, refers_to long, date string, refers_to_uri string, refers_to_date string"
)
#: http: the HTTP head of responses and revisits. raw: the whole record, where it is neither.
RECORD = HEADERS + ", http binary, payload binary, raw binary"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: 32 digits of 5 bits, from 8 groups of 20."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cut)), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null. Line ends in a value are escaped."""
    value = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record(kind: Column) -> Column:
    """A record without its end, from columns as in RECORD. Revisits have HTTP headers and no payload, other kinds are as in raw."""
    http = F.concat(F.col("http").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(kind == "response", F.concat(http, F.col("payload").cast("string"))).otherwise(http)
    profile = F.when(kind == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fresh = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", F.col("record_id")), _line("WARC-Date", F.col("date")), _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), _line("WARC-Profile", profile), _line("WARC-Refers-To", F.col("refers_to_id")),
        _line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")), _line("WARC-Refers-To-Date", F.col("refers_to_date")),
        _line("X-Page-ID", F.col("page_id")), _line("X-Refers-To-Page-ID", F.col("refers_to")), _line("X-Payload-Length", F.when(kind == "revisit", F.col("payload_bytes"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block,
    )
    return F.coalesce(F.col("raw").cast("string"), fresh)


def write(records: DataFrame, path: str, per_file: int = RECORDS) -> None:
    """Write records (columns as in RECORD) as gzip archives below path, each of per_file * SMALL bytes at most or of one record.

    Records lie in folders by class of size and by their number in their task, so many to a folder as fit.
    """
    size = F.coalesce(F.octet_length("raw"), F.octet_length("payload"), F.lit(0))
    cls = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / F.lit(SMALL)) / 2)).cast("int")
    fit = F.greatest(F.lit(1), F.floor(F.lit(per_file) / F.pow(F.lit(4.0), cls))).cast("long")
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    text = records.select(record(F.col("kind")).alias("value"), cls.alias("size_class"), F.floor(nth / fit).alias("run"))
    text.write.partitionBy("size_class", "run").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def page_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response for each page: payload the html as UTF-8, empty for null. Every row gets an id of its own."""
    rows = pages.select("page_id", F.col("url").alias("uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("uid"))
    digest, none = base32_sha1(F.col("payload")), F.lit(None).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"))
    return rows.select(
        _uuid(F.col("uid"), F.col("page_id")).alias("record_id"), F.col("page_id").cast("long").alias("page_id"), "uri", digest.alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.lit("response").alias("kind"), none.alias("refers_to_id"), F.lit(None).cast("long").alias("refers_to"),
        F.lit(date).alias("date"), none.alias("refers_to_uri"), none.alias("refers_to_date"), http.cast("binary").alias("http"), "payload", F.lit(None).cast("binary").alias("raw"),
    )


class _Inflated(io.RawIOBase):
    """The bytes of an archive, inflated bit by bit if it is compressed (of several members, too)."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.rest = memoryview(raw), 0, b""
        self.zip = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest and self.at < len(self.raw):
            part = bytes(self.raw[self.at : self.at + STEP])
            self.at += len(part)
            if not self.zip:
                self.rest = part
                continue
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
            self.rest = self.zip.decompress(part)
            if self.zip.eof:
                self.at -= len(self.zip.unused_data)
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    return ((head, block) for _, head, block in _records(raw))


def _records(raw: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """The bytes before the block, headers and block of each record of an archive."""
    source = io.BufferedReader(_Inflated(raw), STEP)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        before = [line]
        while (line := source.readline()).strip():
            before.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = source.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a WARC record is cut off")
        yield b"".join([*before, line]), head, block


def _parsed(frames: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in (RECORD if payloads else HEADERS).split(", ")]
    number = lambda x: None if x is None else int(x)
    for pdf in frames:
        for content in pdf["content"]:
            rows, held = [], 0
            for before, head, block in _records(content):
                kind = head.get("warc-type")
                known = kind in ("response", "revisit") and head.get("content-type", "application/http").startswith("application/http")
                raw = None if known else before + block
                http, _, payload = block.partition(b"\r\n\r\n")
                digest, size = head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
                if raw is not None:
                    http, payload, kind = None, b"", "other" if kind in ("response", "revisit") else kind
                elif kind == "response":
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324
                    if digest and own != digest and head["warc-payload-digest"].startswith("sha1:"):
                        raise ValueError(f"payload of {head.get('warc-record-id')} doesn't have its digest")
                    size, digest = len(payload), own
                else:
                    found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    size = number(head.get("x-payload-length", found[1] if found else None))
                row = (
                    head.get("warc-record-id"), number(head.get("x-page-id")), head.get("warc-target-uri"), digest, size, kind, head.get("warc-refers-to"), number(head.get("x-refers-to-page-id")),
                    head.get("warc-date"), head.get("warc-refers-to-target-uri"), head.get("warc-refers-to-date"),
                )
                rows.append((*row, http, payload, raw) if payloads else row)
                held += len(payload) + len(raw or b"") if payloads else 0
                if len(rows) >= 4096 or held >= 1 << 24:
                    yield _frame(rows, names)
                    rows, held = [], 0
            if rows:
                yield _frame(rows, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object).astype({k: "Int64" for k in ("page_id", "payload_bytes", "refers_to")})


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all types of the archives (.gz or .warc) below path, with or without payloads. Digests of responses are verified.

    Responses and revisits that aren't HTTP are of kind "other" and stay as they are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return files.mapInPandas(lambda frames: _parsed(frames, payloads), RECORD if payloads else HEADERS)


#: What a revisit says of the response that it refers to.
_REFERENCE = ("refers_to_id", "refers_to", "refers_to_uri", "refers_to_date")


def _few(rows: DataFrame) -> DataFrame:
    """rows, broadcast if their number is bounded."""
    return F.broadcast(rows) if count(rows) <= BROADCAST_REVISITS else rows


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records that revisit another: record_id, and refers_to_id, refers_to (its page_id), refers_to_uri and refers_to_date.

    Of responses with equal payloads of least_bytes or more that with the largest page_id stays, of equal
    page_ids (null is smallest) that with the largest record id.
    """
    rows = headers.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes)).select("digest", "payload_bytes", "page_id", "record_id", "uri", "date")
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "record_id", "uri", "date")).alias("kept")
    kept = rows.groupBy("digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), best).where("n > 1")
    kept = kept.select("digest", "payload_bytes", *(F.col(f"kept.{c}").alias(r) for c, r in zip(("record_id", "page_id", "uri", "date"), _REFERENCE, strict=True)))
    # Digests of one record are gone before the join; a digest of very many has its records split among tasks.
    return rows.join(_few(materialize(kept, "kept")), ["digest", "payload_bytes"]).where(F.col("record_id") != F.col("refers_to_id")).select("record_id", *_REFERENCE)


def redirect(headers: DataFrame, revisits: DataFrame) -> DataFrame:
    """The revisits among headers whose original is there: record_id and its reference, as resolve() leaves responses.

    The original is the response that a revisit names, else one of its digest (the largest page_id, then record id).
    """
    moved = revisits.select(F.col("record_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in _REFERENCE))
    stays = headers.where("kind = 'response'").select("record_id", "digest", "page_id", "uri", "date").join(moved, F.col("record_id") == F.col("__id"), "left")
    gone = F.col("__id").isNotNull()
    to = [F.when(gone, F.col(f"__{r}")).otherwise(F.col(c)).alias(r) for c, r in zip(("record_id", "page_id", "uri", "date"), _REFERENCE, strict=True)]
    stays = stays.select("record_id", "digest", *to)
    best = F.max(F.struct(F.col("refers_to").isNotNull().alias("has"), "refers_to", "refers_to_id", "refers_to_uri", "refers_to_date")).alias("best")
    named, alike = (_few(materialize(stays.groupBy(F.col(c).alias(f"__{c}")).agg(best.alias(f"by_{c}")), "originals")) for c in ("record_id", "digest"))
    old = headers.where("kind = 'revisit'").select("record_id", F.col("refers_to_id").alias("__old"), "digest").dropDuplicates(["record_id"])
    old = old.join(named, F.col("__old") == F.col("__record_id"), "left").join(alike, F.col("digest") == F.col("__digest"), "left")
    found = F.coalesce("by_record_id", "by_digest")
    return old.where(found.isNotNull()).select("record_id", *(found[c].alias(c) for c in _REFERENCE))


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0, per_file: int = RECORDS) -> None:
    """Read the archives below source and write them below target, with revisits for repeated payloads.

    Revisits that source already has stay, and refer to the response that stays for theirs, if source has
    one. Headers of both are written afresh, with the capture's own date, address and HTTP head; records of
    other types stay as they are.
    """
    headers = materialize(read(spark, source, payloads=False).where("kind in ('response', 'revisit')"), "headers")
    revisits = materialize(resolve(headers, least_bytes), "revisits")
    if not headers.where("kind = 'revisit'").isEmpty():
        revisits = materialize(revisits.union(redirect(headers, revisits)), "redirected")
    known = _few(revisits.select(F.col("record_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in _REFERENCE)))
    rows = read(spark, source).join(known, F.col("record_id") == F.col("__id"), "left")
    again = F.col("__id").isNotNull()
    fresh = again & (F.col("kind") == "response")
    rows = rows.withColumns({
        **{c: F.when(again, F.col(f"__{c}")).otherwise(F.col(c)) for c in _REFERENCE},
        "kind": F.when(again, "revisit").otherwise(F.col("kind")), "record_id": F.when(fresh, _uuid(F.col("record_id"), F.lit("revisit"))).otherwise(F.col("record_id")),
    })
    write(rows, target, per_file)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) to archives, deduplicate those, and read the result back.

    Per page: page_id, payload_bytes, payload_digest (bare base32 SHA-1), record_type (response, revisit),
    refers_to (a revisit's response's page_id). A null html is an empty payload, a null url is left out.
    Rows that repeat a page stay rows of their own. An empty table gives none.
    """
    spark = pages.sparkSession
    raw, lean = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write(page_records(pages), raw)
    deduplicate(spark, raw, lean, least_bytes)
    return read(spark, lean, payloads=False).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY s) AS kept FROM d
)
SELECT page_id, payload_bytes,
  translate(array_to_string(list_transform([0, 1, 2, 3, 4, 5, 6, 7],
      lambda i: upper(lpad(to_base(CAST('0x' || substr(s, CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT), 32), 4, '0'))), ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM g
"""
