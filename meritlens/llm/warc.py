"""WARC archives: written from pages with revisits, read back by boundary-chain verification."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlens.llm.common import bit_table, drop_folder, group_apart, materialise, maybe_member, new_folder

#: What ends a record, and a header.
BREAK = "\r\n\r\n"
#: Equal payloads of at least so many bytes are written once.
LEAST = 100
#: Records in an archive file, at most.
RECORDS = 4096
#: The table has no crawl times.
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, records: int = RECORDS) -> None:
    """Write one record per page (page_id, url, html) as gzip-compressed WARC files.

    Of equal payloads (html in UTF-8, null is empty) with at least ``least`` bytes, the record with
    the smallest page_id is a response and the others are revisits that refer to it, with the HTTP
    header but no payload. Only pages whose digest may occur twice are joined with the first ones;
    a bit table of fixed size tells them, so other payloads are written where they are read. Line
    ends in an url are escaped, a null url has no header. A null page_id is written as an empty id
    and is never referred to. Repeated rows with the same id are all written as responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    first = group_apart(rows.where(F.col("size") >= least), ["digest"], F.min("page_id").alias("refers"), F.count("*").alias("c"))
    first = materialise(first.where("c > 1").drop("c"))
    marked = maybe_member(rows, F.xxhash64("digest"), bit_table(first, F.xxhash64("digest")), "twice")
    joined = marked.where("twice").join(first, "digest", "left")
    rows = marked.where("NOT twice").withColumn("refers", F.lit(None).cast("long")).unionByName(joined)
    again = F.col("refers").isNotNull() & (F.col("size") >= least) & ~F.col("refers").eqNullSafe(F.col("page_id"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(BREAK))
    body = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), name("refers"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body").cast("string"),
        F.lit(BREAK), F.col("body"),
    )
    written = rows.withColumn("body", body).select(record.alias("value"))
    written.write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)


class _Record:
    """A candidate whose end is ahead; with ``hashing`` its content is hashed while it passes by."""

    def __init__(self, start: int, content: int, header: dict[bytes, bytes], hashing: bool, payload: bool) -> None:
        self.start, self.header = start, header
        self.content, self.end = content, content + int(header[b"content-length"])
        self.body = None  # where the payload begins
        self.digest, self.size = hashlib.sha256() if hashing else None, 0
        self.kept = [] if hashing and payload else None

    def take(self, at: int, piece: bytes) -> None:
        """Bytes of the stream from ``at``; the first piece of an HTTP block is its header."""
        if self.body is None:
            http = self.header.get(b"content-type", b"").startswith(b"application/http") and piece.startswith(b"HTTP/")
            self.body = at + len(piece) if http else self.content
        piece = piece[max(0, self.body - at) : max(0, self.end - at)]
        self.digest.update(piece)
        self.size += len(piece)
        if self.kept is not None:
            self.kept.append(piece)

    def row(self, file: str) -> dict:
        text = lambda k: self.header[k].decode("utf-8", "replace") if k in self.header else None
        return {
            "file": file, "start": self.start, "next": self.end + 4, "type": text(b"warc-type"), "record_id": text(b"warc-record-id"),
            "uri": text(b"warc-target-uri"), "refers_to": text(b"warc-refers-to"), "stated_digest": text(b"warc-payload-digest"),
            "payload_bytes": self.size if self.digest else None, "payload_digest": self.digest.hexdigest() if self.digest else None,
            "payload": b"".join(self.kept) if self.kept is not None else None,
        }


_SCHEMA = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("next", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()),
    ("refers_to", pa.string()), ("stated_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
_MAGIC = b"WARC/1."
#: Header fields that are read.
_FIELDS = {b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-refers-to", b"warc-payload-digest", b"content-type", b"content-length"}


def _headers(piece: bytes) -> list[tuple[int, dict[bytes, bytes]]]:
    """Places in a piece where a record header may begin, with its fields; the header ends with the piece.

    Lines are read from the last to the first, so a piece is read once however many places it has.
    """
    found: list[tuple[int, dict[bytes, bytes]]] = []
    fields: dict[bytes, bytes] = {}
    end = len(piece) if _MAGIC in piece else -1
    while end >= 0:
        before = piece.rfind(b"\r\n", 0, end)
        begin = before + 2 if before >= 0 else 0
        at = piece.rfind(_MAGIC, max(begin, end - 12), end)
        length = fields.get(b"content-length", b"")
        if at >= 0 and b"warc-type" in fields and length.isdigit() and len(length) <= 18:
            found.append((at, dict(fields)))
        key, colon, value = piece[begin:end].partition(b":")
        key = key.strip().lower()
        if colon and key in _FIELDS:
            fields.setdefault(key, value.strip())
        end = before
    return found[::-1]


class Scan:
    """Candidates of one file, from its pieces in their order; ``rows`` are those whose end has passed by.

    A candidate is hashed if it begins where no hashed one reaches. The first record begins at the start
    of the file and each next one where the one before ends, so all records of the chain are
    hashed; what looks like a record inside them gives its offsets only, and no byte is hashed twice.
    """

    def __init__(self, file: str | None, payload: bool = False) -> None:
        self.file, self.payload = file, payload
        self.at = self.clear = 0
        self.hashed: list[_Record] = []
        self.inside: list[tuple[int, int, _Record]] = []  # a heap by end
        self.rows: list[dict] = []

    def take(self, piece: bytes) -> None:
        whole = piece + b"\r\n\r\n"
        for r in self.hashed:
            r.take(self.at, whole)
        for p, header in _headers(piece):
            start = self.at + p
            r = _Record(start, self.at + len(whole), header, start >= self.clear, self.payload)
            if r.digest:
                self.hashed.append(r)
                self.clear = r.end + 4
            else:
                heapq.heappush(self.inside, (r.end, start, r))
        self.at += len(whole)
        self.rows += [r.row(self.file) for r in self.hashed if r.end <= self.at]
        self.hashed = [r for r in self.hashed if r.end > self.at]
        while self.inside and self.inside[0][0] <= self.at:
            self.rows.append(heapq.heappop(self.inside)[2].row(self.file))


def candidates(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Every place of an archive that looks like a record, with the place after it.

    Spark's text reader streams a compressed file in one task, cut at blank lines; places are sums
    of piece lengths. A payload is hashed while it passes by, so memory does not grow with
    a record (unless ``payload`` is asked for). Candidates inside other records' payloads are given
    as well, with null for size and digest; records cut off by the end of the file are not.
    """
    pieces = spark.read.option("lineSep", BREAK).text(folder).select(F.col("value").cast("binary").alias("value"), "_metadata.file_path", "_metadata.file_block_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(None)
        for batch in batches:
            rows = []
            for value, path, block in zip(*batch.columns, strict=True):
                if path.as_py() != scan.file:
                    if block.as_py():
                        raise ValueError(f"{path} is not compressed as one stream: archives are read in one piece")
                    scan = Scan(path.as_py(), payload)
                scan.take(value.as_py())
                rows += scan.rows
                scan.rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    kinds = "file string, start long, next long, type string, record_id string, uri string, refers_to string, stated_digest string, payload_bytes long"
    return pieces.mapInArrow(run, f"{kinds}, payload_digest string, payload binary")


def reachable(links: DataFrame) -> DataFrame:
    """Of candidates (file, start, next) those on the chain from the start of their file: (file, start).

    Pointer jumping: in each round every pointer is replaced by the pointer of its target, and what
    reached candidates point to is reached, so the reached stretch of a chain doubles.
    """
    spark = links.sparkSession
    state = links.select("file", "start", F.col("next").alias("to"), (F.col("start") == 0).alias("reached"))
    path, known = None, -1
    while True:
        new_path = new_folder(spark, "chain")
        state.write.parquet(new_path)
        state = spark.read.schema(state.schema).parquet(new_path)
        if path:
            drop_folder(spark, path)
        path = new_path
        count = state.where("reached").count()
        if count == known:
            return state.where("reached").select("file", "start")
        known = count
        target = state.select("file", F.col("start").alias("to"), F.col("to").alias("far"))
        marks = state.where("reached").select("file", F.col("to").alias("start"), F.lit(True).alias("mark"))
        state = (
            state.join(target, ["file", "to"], "left")
            .join(marks, ["file", "start"], "left")
            .select("file", "start", F.col("far").alias("to"), (F.col("reached") | F.coalesce("mark", F.lit(False))).alias("reached"))
        )


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Records of the compressed archives in a folder: those reachable from the start of their file.

    Text that only looks like a record inside a payload is not on that chain. A file whose chain
    breaks gives the records before the break. ``payload_bytes`` and ``payload_digest`` are those of
    the bytes read; ``payload`` is null unless asked for.
    """
    found = candidates(spark, folder, payload).withColumn("file", F.xxhash64("file"))
    found = materialise(found)
    return found.join(reachable(found.select("file", "start", "next").distinct()), ["file", "start"])


def op4_warc(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back; what a revisit refers to gives its payload's size and digest."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder)
    number = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    light = read_archives(spark, folder).select(
        as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), as_id("refers_to").alias("refers_to")
    )
    light = materialise(light)
    full = light.where("record_type = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")
    )
    revisits = light.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(full.dropDuplicates(["refers_to"]), "refers_to", "left")
    revisits = revisits.withColumnsRenamed({"n": "payload_bytes", "d": "payload_digest"})
    return light.where("record_type != 'revisit'").unionByName(revisits)


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
