"""WARC archives: writing captures, reading records back and assembling transactions.

A capture is written as three records: the request, the response (or a revisit, if an earlier
response has the same payload) and metadata; request and metadata name the response in
WARC-Concurrent-To. Spark's text writer puts the records into gzip files, with the end mark of a
record as its line separator; the payload's bytes pass through as they are. Reading takes each file
in one task and decompresses it piece by piece, record by record by Content-Length, and assembly
joins the records of a transaction by their identifiers. Popular payloads are dealt out by SALTS.
"""

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, shared_dir

#: Records in a file at most, so that what a reading task holds, one compressed file, is bounded.
RECORDS_PER_FILE = 6_000
#: Parts that a popular payload's captures are dealt to in joins.
SALTS = 16
#: Bytes that are decompressed at once.
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_length long, digest_ok boolean, block string, payload binary"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits are four of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("-")) for c in of]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", smallest_revisit: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_id, refers_to (null for a response).

    Of captures with equal payloads of at least smallest_revisit bytes the one with the smallest
    page id (null last; ties by url, null first) is the response. Repeated rows are captures of their
    own. Null payloads are empty.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    rank = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "url")
    shared = rows.where(F.col("payload_bytes") >= smallest_revisit).groupBy("payload_digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    named = lambda page, url, number: _urn("response", page, url, F.col("payload_digest"), number)
    shared = shared.select("payload_digest", named(F.col("first.page_id"), F.col("first.url"), F.lit(1)).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(shared, ["payload_digest", "salt"], "left")
    again = F.row_number().over(Window.partitionBy("payload_digest", "salt", "page_id", "url").orderBy("payload_bytes"))
    joined = joined.withColumn("record_id", named(F.col("page_id"), F.col("url"), again))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_id", F.when(F.col("first") != F.col("record_id"), F.col("first")).alias("refers_to"))


def write_warc(found: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes captures() to gzip WARC files below a path."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise("")
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    host = F.regexp_extract(uri, r"://([^/?#]*)", 1)
    target = F.regexp_replace(F.regexp_replace(uri, r"^[^:]*://[^/?#]*", ""), "^(?!/)", "/")

    def record(kind: Column, record_id: Column, content_type: str, headers: list[Column], block: Column) -> Column:
        head = F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: "), kind, F.lit(CRLF), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri), *headers)
        size = F.concat(line("Content-Type", F.lit(content_type)), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
        return F.concat(head, size, block)

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    own = F.col("record_id")
    revisit = F.col("refers_to").isNotNull()
    digest = line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))
    profile = F.when(revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{CRLF}")).otherwise("")
    answer = F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    fields = F.concat(F.lit("payload-length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF), F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF))).otherwise(""))
    together = [line("WARC-Concurrent-To", own)]
    request = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF * 2))
    records = [
        record(F.lit("request"), _urn("request", own), "application/http; msgtype=request", together, request),
        record(F.when(revisit, F.lit("revisit")).otherwise("response"), own, "application/http; msgtype=response", [digest, profile, line("WARC-Refers-To", F.col("refers_to"))], answer),
        record(F.lit("metadata"), _urn("metadata", own), "application/warc-fields", together, fields),
    ]
    lines = found.select(F.explode(F.array(*records)).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def pieces(content: bytes) -> Iterator[bytes]:
    """A plain or gzip file, decompressed piece by piece; gzip members, of records or of whole files, follow one another."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), PIECE):
            yield content[at : at + PIECE]
        return
    while content:
        member, rest = zlib.decompressobj(wbits=31), content
        while rest and not member.eof:
            yield member.decompress(rest, PIECE)
            rest = member.unconsumed_tail
        content = member.unused_data


def parse_records(parts: Iterator[bytes]) -> Iterator[dict]:
    """Records of an uncompressed WARC file that comes in parts. A record cut short ends the file."""
    held, at, parts = bytearray(), 0, iter(parts)

    def more() -> bool:
        nonlocal at
        part = next(parts, None)
        if part is None:
            return False
        del held[:at]
        at = 0
        held.extend(part)
        return True

    while True:
        begin = held.find(b"WARC/", at)
        head_end = held.find(b"\r\n\r\n", begin) if begin >= 0 else -1
        if head_end < 0:
            if not more():
                return
            continue
        headers: dict[str, str] = {}
        name = None
        for part in held[begin:head_end].decode("utf-8", "replace").split(CRLF)[1:]:
            if part[:1] in (" ", "\t") and name:
                headers[name] += " " + part.strip()
            elif ":" in part:
                name, value = part.split(":", 1)
                name = name.strip().lower()
                headers[name] = value.strip()
        size = headers.get("content-length", "")
        if not re.fullmatch("[0-9]+", size):
            return
        first = head_end + 4 - at
        while len(held) - at < first + int(size):
            if not more():
                return
        yield headers | {"_block": bytes(held[at + first : at + first + int(size)])}
        at += first + int(size)


def _rows(content: bytes, with_payload: bool) -> Iterator[dict]:
    for r in parse_records(pieces(content)):
        kind, block, digest = r.get("warc-type"), r["_block"], r.get("warc-payload-digest", "")
        row = {"type": kind, "record_id": r.get("warc-record-id"), "concurrent_to": r.get("warc-concurrent-to"), "refers_to": r.get("warc-refers-to"), "target_uri": r.get("warc-target-uri"), "payload_digest": digest.removeprefix("sha1:") or None, "payload_length": None, "digest_ok": None, "block": None, "payload": None}
        if kind == "response":
            end = block.find(b"\r\n\r\n")
            body = block[end + 4 :] if end >= 0 and block.startswith(b"HTTP/") else block
            sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
            row |= {"payload_length": len(body), "digest_ok": sha == (row["payload_digest"] or sha), "payload_digest": sha, "payload": body if with_payload else None}
        else:
            row["block"] = block.decode("utf-8", "replace")
        yield row


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the WARC files (plain or gzip) below a path."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                some, size = [], 0
                for row in _rows(content.as_py(), with_payload):
                    some.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, size = [], 0
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, request, metadata.

    Requests and metadata meet the response or revisit that they are concurrent to; of several of a
    kind the one with the smallest record id counts, so repeated records come out once. Requests
    and metadata without a capture come out with a null response; records of other kinds and
    those without identifiers are left out.
    """
    whole = F.struct(*[c for c in records.columns if c not in ("concurrent_to",)])
    kind = F.col("type")
    own = kind.isin("response", "revisit")
    key = F.when(own, F.col("record_id")).when(kind.isin("request", "metadata"), F.col("concurrent_to"))
    small = F.struct("record_id", "target_uri", "block")
    keyed = records.select(key.alias("key"), F.when(own, whole).alias("r"), F.when(kind == "request", small).alias("q"), F.when(kind == "metadata", small).alias("m")).where("key IS NOT NULL")
    return keyed.groupBy(F.col("key").alias("record_id")).agg(F.min("r").alias("response"), F.min("q").alias("request"), F.min("m").alias("metadata"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    found = assemble(read_warc(spark, path, with_payload=False)).where("response IS NOT NULL")
    page_id = F.regexp_extract("metadata.block", r"page-id: (-?\d+)", 1).cast("long").alias("page_id")
    rows = cut(found.select("record_id", page_id, F.col("response.payload_length").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to")))
    remove(spark, path)
    # only revisits look for another record, and only records that they name are looked for
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    named = revisits.select(F.col("to").alias("record_id")).distinct()
    first = rows.where("record_type = 'response'").join(named, "record_id", "left_semi")
    first = first.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), "payload_bytes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = rows.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*names)
    return responses.unionByName(revisits.join(first, ["to", "salt"], "left").select(*names))
