"""WARC archives: writing, reading and assembling transactions.

``write_archive`` turns captures into request, response (or revisit) and
metadata records and writes them as gzipped WARC/1.1 files with Spark's text
writer: each row is one record, and the two empty lines that end a record are
the writer's line separator, so no worker touches a file system by itself.

``read_records`` reads whole files (``binaryFile``) and walks them by
Content-Length; ``assemble`` joins request, response and metadata records
through WARC-Concurrent-To into one nested row per capture.

Payloads: UTF-8 of the text, null as empty. Of captures with equal payloads of
at least ``min_bytes`` bytes, that with the largest id is the response and the
others are revisits that refer to it; smaller ones are all responses. A third
of all captures may share one payload: the largest ids are stored before the
join with the captures, so the join's hot partition can be split at run time.
Repeated rows (equal id and payload) are all responses or all revisits, share
their record ids and read back as just as many captures; a null id writes a record without one, reads back as
null and sorts below every id. Null urls have no target header. Line breaks in
urls are escaped. Columns other than id, url and payload do not pass. An empty
table gives archives without records. A file holds about ``FILE_BYTES`` of payload
(records of the average length) and is one gzip member, as Spark's writer makes
it. A task holds a file as stored, compressed, and inflates it record by
record, so a very long payload needs room for itself.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tridelta.session import scratch_path

from .common import map_arrow, store

# Payload that a file holds on average, and what a worker inflates at a time.
FILE_BYTES, PIECE = 256 << 20, 1 << 20
CRLF = "\r\n"
RECORD_END = CRLF + CRLF
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF
RECORD_FIELDS = ("type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, "
                 "payload_digest string, block_bytes bigint, payload_bytes bigint, computed_digest string, block binary")


def base32_sha1(payload: Column) -> Column:
    """RFC 4648 base 32 of the SHA-1 digest (160 bits: no padding). Five hex
    digits at a time are twenty bits, which are four characters."""
    sha = F.sha1(payload)
    chars = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(sha, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            chars.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*chars)


def _record(headers: list[Column], block: Column) -> Column:
    """One record without its end; headers that are null are left out."""
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *headers, size), F.lit(CRLF + CRLF), block)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value)


def plan_captures(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """id, url, payload (string), payload_bytes, payload_digest, refers_to
    (the response's id for a revisit, else null)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    caps = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    caps = (caps.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary"))))
    last = store(caps.where(F.col("payload_bytes") >= min_bytes)
                 .groupBy("payload_digest").agg(F.max("id").alias("last_id")), "warc-last")
    caps = caps.join(last, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("last_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("last_id"))
    return caps.select("id", "url", "payload", "payload_bytes", "payload_digest",
                       F.when(revisit, F.col("last_id")).alias("refers_to"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cut)), F.lit(">"))


def records(captures: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the text of each record. A response's record id is
    made from capture id and payload, so a revisit can name what it refers to."""
    def response_id(col: Column) -> Column:
        return _uuid(F.lit("response"), F.coalesce(col.cast("string"), F.lit("null")), F.col("payload_digest"))

    revisit = F.col("refers_to").isNotNull()
    own_id = response_id(F.col("id"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    stamp, uri = _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", url)
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))

    def kind(name: Column) -> Column:
        return _header("WARC-Type", name)

    response = _record(
        [kind(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), _header("WARC-Record-ID", own_id), stamp, uri,
         digest, F.when(revisit, _header("WARC-Refers-To", response_id(F.col("refers_to")))),
         F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         F.lit("Content-Type: application/http; msgtype=response")],
        F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("payload"))))
    concurrent = _header("WARC-Concurrent-To", own_id)
    request = _record(
        [kind(F.lit("request")), _header("WARC-Record-ID", _uuid(F.lit("request"), own_id)), stamp, uri, concurrent,
         F.lit("Content-Type: application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF)))
    fields = F.concat_ws(CRLF, _header("captureId", F.col("id").cast("string")),
                         _header("payloadBytes", F.col("payload_bytes").cast("string")))
    metadata = _record(
        [kind(F.lit("metadata")), _header("WARC-Record-ID", _uuid(F.lit("metadata"), own_id)), stamp, uri, concurrent,
         F.lit("Content-Type: application/warc-fields")], F.concat(fields, F.lit(CRLF)))
    return captures.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archive(captures: DataFrame, path: str, records_per_file: int = 30_000) -> None:
    (records(captures).write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def file_records(pages: DataFrame, payload_col: str, file_bytes: int = FILE_BYTES, most: int = 30_000) -> int:
    """Records (three a capture) of which a file holds about ``file_bytes`` of payload."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(payload_col), F.lit(0)))).head()[0] or 0.0
    return int(max(3, min(most, 3 * file_bytes / max(1.0, mean))))


def _inflated(data: bytes) -> Iterator[bytes]:
    """The archive's bytes piece by piece, plain or gzipped (one member or many)."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield data[at:at + PIECE]
        return
    at = 0
    while at < len(data):
        if data[at:at + 2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("the archive's gzip data is cut off")
            fed = data[at:at + PIECE]
            at += len(fed)
            out = member.decompress(fed, PIECE)
            yield out
            while not member.eof and (out or member.unconsumed_tail):
                out = member.decompress(member.unconsumed_tail, PIECE)
                yield out
        at -= len(member.unused_data)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """(headers by lower-case name, block) of every record of one archive,
    plain or gzipped (one member or many), of which one record at a time is held
    inflated. A broken archive fails, after the records before the break."""
    pieces, held, done = _inflated(data), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while held or more():
        if not held:
            continue
        end, seen = -1, 0
        while end < 0:
            end = held.find(b"\r\n\r\n", seen)
            seen = max(0, len(held) - 3)
            if end < 0 and not more():
                break
        lines = held[:end].decode("utf-8").split(CRLF) if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {done}")
        headers: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        start, size = end + 4, int(headers["content-length"][0])
        while len(held) < start + size + 4 and more():
            pass
        if held[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {done} does not end where its length says")
        yield headers, memoryview(bytes(held[start:start + size]))
        del held[:start + size + 4]
        done += start + size + 4


def read_records(spark: SparkSession, path: str, blocks: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """One row per record (RECORD_FIELDS). ``payload_bytes`` and
    ``computed_digest`` are taken from the block itself: for application/http
    it is what follows the head. Without ``blocks`` the block is left null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(),
                 pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for h, block in parse_records(content.as_py()):
                    get = lambda name: h.get(name, [None])[0]
                    payload = block
                    if (get("content-type") or "").startswith("application/http"):
                        head = bytes(block).find(b"\r\n\r\n")
                        payload = block[head + 4 if head >= 0 else len(block):]
                    digest = get("warc-payload-digest")
                    rows.append((get("warc-type"), get("warc-record-id"), h.get("warc-concurrent-to", []), get("warc-refers-to"),
                                 get("warc-target-uri"), digest.partition(":")[2] if digest else None, len(block),
                                 len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                                 bytes(block) if blocks or get("warc-type") == "metadata" else None))
                    held += len(block)
                    if held > batch_bytes or len(rows) >= 4096:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, run, RECORD_FIELDS)


def assemble(recs: DataFrame) -> DataFrame:
    """One row per capture: record_id, response (struct; its type tells a
    revisit), requests and metadata (arrays of structs, mostly of one), joined
    through WARC-Concurrent-To in whichever record it stands. Records of no
    capture (warcinfo and the like) are left out."""
    main = F.col("type").isin("response", "revisit", "resource")
    fields = [c for c in recs.columns]
    heads = recs.where(main).select(F.col("record_id").alias("capture"), F.struct(*fields).alias("response"))
    side = recs.where(F.col("type").isin("request", "metadata"))
    named = side.select(F.explode("concurrent_to").alias("capture"), F.struct(*fields).alias("rec"))
    naming = (recs.where(main).select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other"))
              .join(side.select(F.col("record_id").alias("other"), F.struct(*fields).alias("rec")), "other")
              .select("capture", "rec"))
    linked = named.unionByName(naming)
    grouped = linked.groupBy("capture").agg(
        F.array_sort(F.collect_set(F.when(F.col("rec.type") == "request", F.col("rec")))).alias("requests"),
        F.array_sort(F.collect_set(F.when(F.col("rec.type") == "metadata", F.col("rec")))).alias("metadata"))
    return heads.join(grouped, "capture", "left").select(F.col("capture").alias("record_id"), "response", "requests", "metadata")


def capture_table(captures: DataFrame) -> DataFrame:
    """id (as text), payload_bytes, payload_digest, record_type, refers_to (the
    id of the capture whose response a revisit names) of assembled captures;
    bytes and digest of a revisit are those of the payload it stands for."""
    about = F.decode(F.element_at("metadata", 1)["block"], "UTF-8")
    flat = store(captures.select(
        "record_id", F.nullif(F.regexp_extract(about, r"(?m)^captureId: ([^\r\n]*)", 1), F.lit("")).alias("id"),
        F.col("response.type").alias("record_type"), F.col("response.payload_bytes").alias("own_bytes"),
        F.col("response.computed_digest").alias("own_digest"), F.col("response.payload_digest").alias("said_digest"),
        F.col("response.refers_to").alias("refers_record")), "warc-captures")
    responses = store(flat.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_record")).agg(
        F.min("id").alias("refers_to"), F.min("own_bytes").alias("their_bytes"), F.min("own_digest").alias("their_digest")),
        "warc-responses")
    rows = flat.join(responses, "refers_record", "left")
    revisit = F.col("record_type") == "revisit"
    return rows.select("id", F.when(revisit, F.col("their_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
                       F.when(revisit, F.col("their_digest")).otherwise(F.col("own_digest")).alias("payload_digest"),
                       "record_type", F.when(revisit, F.col("refers_to")).alias("refers_to"), "said_digest")


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write an archive of ``pages`` and return its assembled captures."""
    path = path or scratch_path(spark, "warc")
    write_archive(plan_captures(pages, id_col, url_col, payload_col, min_bytes), path, file_records(pages, payload_col))
    return assemble(store(read_records(spark, path, blocks=False), "warc-records"))
