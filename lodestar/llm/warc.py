"""WARC archives whose repeated payloads are revisit records.

Pages become WARC records. Only headers (digest, id, url) are shuffled by
payload digest to find the first record of each payload; the records are then
joined to the firsts of recurring digests and written with fresh headers: the
first as ``response``, the others as ``revisit`` without the payload. Readers go
by Content-Length, so payloads may hold anything, and revisits are resolved by a
join with the original responses. Archives may be rewritten together, which
finds repeats across them.

The files come from Spark's text sink, whose line separator is the blank line
pair that ends a record: any store that Spark writes to will do, and the commit
protocol survives lost executors. A file is one gzip stream (or plain), as large
as a shuffle partition; readers take one gzip member a record as well.

Defined cases: a null payload is an empty one; records without a key come last
in order and keep no key; of rows equal in key and url one is the response; a
page without url is named ``urn:page:`` and its key; line breaks and other
control characters of urls and keys are percent-encoded; a digest that a third
of all records share is spread over ``SALTS`` parts; very long payloads are one
record; an empty table gives archives without records; other columns are not
archived, whatever their names. SHA-1 stands for the payload, as everywhere in
this format.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import slices, stored

#: Parts into which the records of one digest are dealt.
SALTS = 32
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Bytes of records that a task hands on at a time.
LOT = 8 << 20


def base32_of_hex(digits: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits: five of them are four letters."""
    fours = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(x: object) -> str | None:
    """Without the characters that would end a header line."""
    return None if x is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in str(x))


def _name(key: str | None, url: str | None, digest: str) -> str:
    """The id of the response that holds a payload: the same wherever it is worked out."""
    raw = hashlib.sha256("\0".join(("-" if x is None else f"+{x}") for x in (key, url, digest)).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=raw[:16], version=4)}>"


def _record(kind: str, name: str, stamp: str, key: str | None, url: str | None, digest: str, size: int | None, payload: bytes, more: dict[str, str | None]) -> bytes:
    """One record but for the blank lines that end it. ``size`` is that of the full payload, if known."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if size is None else f"Content-Length: {size}\r\n")
    block = http.encode() + b"\r\n" + payload
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": name,
        "WARC-Date": stamp,
        "WARC-Target-URI": _plain(url) or f"urn:page:{_plain(key) or ''}",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "X-Record-Key": _plain(key),
        **more,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n").encode() + block


def _write(rows: DataFrame, path: str, least_bytes: int, stamp: str, compression: str) -> None:
    """Writes rows of key, url, digest, size and payload (null in a revisit whose payload lies elsewhere)."""
    spark = rows.sparkSession
    order = F.struct(F.col("key").isNull(), "key", F.col("url").isNull(), "url", "size")
    heads = rows.select("digest", order.alias("first"), F.col("payload").isNotNull().alias("own"))
    firsts = heads.groupBy("digest").agg(F.min(F.when(F.col("own"), F.col("first"))).alias("first"), F.count(F.lit(1)).alias("n"))
    often = firsts.where((F.col("n") > 1) & (F.col("first.size") >= least_bytes))
    far = often.select(F.col("digest").alias("of"), F.col("first.key").cast("string").alias("first_key"), F.col("first.url").alias("first_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    # rows equal in key, url and digest meet in one task, which can tell the first of them
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).repartition(slices(spark), "digest", "salt")
    met = dealt.join(far.hint("shuffle_hash"), (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("part")), "left")
    lines = met.select(F.col("key").cast("string").alias("key"), "url", "digest", "size", "payload", F.col("of").isNotNull().alias("shared"), "first_key", "first_url")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[str] = set()
        for batch in batches:
            out, held = [], 0
            for key, url, digest, size, payload, shared, first_key, first_url in zip(*(batch.column(i) for i in range(8)), strict=True):
                key, url, digest, size, shared, first_key, first_url = (x.as_py() for x in (key, url, digest, size, shared, first_key, first_url))
                data = payload.as_py()
                if data is not None and not (shared and ((key, url) != (first_key, first_url) or digest in told)):
                    if shared:
                        told.add(digest)
                        name = _name(key, url, digest)
                    else:
                        name = f"<urn:uuid:{uuid.uuid4()}>"
                    out.append(_record("response", name, stamp, key, url, digest, size, data, {}))
                else:
                    more = {"WARC-Profile": PROFILE}
                    if shared:
                        more |= {"WARC-Refers-To": _name(first_key, first_url, digest), "WARC-Refers-To-Target-URI": _plain(first_url) or f"urn:page:{_plain(first_key) or ''}", "WARC-Refers-To-Date": stamp}
                    out.append(_record("revisit", f"<urn:uuid:{uuid.uuid4()}>", stamp, key, url, digest, size, b"", more))
                held += len(out[-1])
                if held >= LOT:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = lines.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", END).option("compression", compression).text(path)


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, stamp: str | None = None, compression: str = "gzip") -> None:
    """Writes a record for each page. Of equal payloads of at least ``least_bytes`` bytes the one with the smallest id
    is the response, the others revisit it; smaller ones are all responses. ``stamp`` is the date of the records."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("key", "url", base32_of_hex(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")
    _write(rows, path, least_bytes, stamp or _now(), compression)


def rewrite_archives(spark: SparkSession, sources: str | list[str], path: str, key_type: str = "bigint", least_bytes: int = 0, stamp: str | None = None, compression: str = "gzip") -> None:
    """Writes the records of archives anew as one collection: repeats across them become revisits, revisits point to the
    response that holds their payload now, and a payload is kept once. A revisit whose payload is nowhere stays one."""
    found = read_archives(spark, sources, key_type, payloads=True).where("record_type IN ('response', 'revisit')")
    rows = found.select("key", "url", F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size"), "payload")
    _write(rows, path, least_bytes, stamp or _now(), compression)


def opened(data: bytes) -> io.BufferedIOBase:
    """The bytes of a file as one stream, unpacked as its first bytes tell."""
    if data[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=io.BytesIO(data))
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True))
    return io.BytesIO(data)


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and block of each record."""
    blank = (b"\r\n", b"\n")
    while line := stream.readline():
        if line in blank:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record was to begin here: {line[:60]!r}")
        fields: dict[str, str] = {}
        last = ""
        while (line := stream.readline()) not in (*blank, b""):
            text = line.decode("utf-8", "replace").strip("\r\n")
            if text[:1] in " \t" and last:
                fields[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        size = int(fields.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"a record ends {size - len(block)} bytes too soon")
        yield fields, block


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The head of the HTTP message and the payload."""
    if not fields.get("content-type", "").startswith("application/http"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[:at], block[at + 4 :])


def _stated_size(head: bytes) -> int | None:
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


RECORDS = "record_type string, record_id string, refers_to_id string, key string, url string, stamp string, stated_digest string, payload_digest string, payload_bytes long"


def read_archives(spark: SparkSession, path: str | list[str], key_type: str = "string", payloads: bool = False) -> DataFrame:
    """One row per record of all types. ``payload_digest`` and ``payload_bytes`` are worked out from the payload, for
    revisits they are what the record states (null if it states none). A task holds one packed file and one record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * payloads
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parsed(opened(content.as_py())):
                    head, payload = _payload(f, block)
                    stated = f.get("warc-payload-digest", "").rpartition(":")[2] or None
                    revisit = f.get("warc-type") == "revisit"
                    digest, size = (stated, _stated_size(head)) if revisit else (sha1_base32(payload), len(payload))
                    rows.append((f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"), f.get("x-record-key"), f.get("warc-target-uri"), f.get("warc-date"), stated, digest, size, *[None if revisit else payload] * payloads))
                    held += 500 + len(payload) * payloads
                    if held >= LOT:
                        yield _batch(rows, names)
                        rows, held = [], 0
                yield _batch(rows, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(read, RECORDS + ", payload binary" * payloads)
    return out.withColumn("key", F.col("key").cast(key_type))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string() for c in names]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Responses and revisits as key, url, payload_bytes, payload_digest, record_type and refers_to: the key of the
    response with the revisit's digest (of several the smallest), which also gives the size of the payload."""
    kept = ["key", "url", "payload_bytes", "payload_digest", "record_type"]
    revisits, responses = records.where("record_type = 'revisit'"), records.where("record_type = 'response'")
    asked = revisits.select(F.col("payload_digest").alias("of")).distinct()
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "payload_bytes")).alias("first")
    originals = responses.join(asked, F.col("payload_digest") == F.col("of"), "left_semi").groupBy("payload_digest").agg(first)
    far = originals.select(F.col("payload_digest").alias("of"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salted = revisits.select(*kept, F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    met = salted.join(far, (F.col("payload_digest") == F.col("of")) & (F.col("salt") == F.col("part")), "left")
    found = met.select("key", "url", F.coalesce("first.payload_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first.key").alias("refers_to"))
    return responses.select(*kept, F.lit(None).cast(records.schema["key"].dataType).alias("refers_to")).unionByName(found)


def archived(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives, reads them back and resolves their revisits: one row per page, with the id's own type."""
    write_archives(pages, path, id_col, url_col, html_col, least_bytes)
    spark = pages.sparkSession
    records = stored(read_archives(spark, path, pages.schema[id_col].dataType.simpleString()), "records")
    return resolve_revisits(records).withColumnRenamed("key", id_col)
