"""WARC archives: written and read back, transactions assembled through concurrent-to identifiers.

Each page becomes three records of WARC/1.1: the request, the response (or a revisit, if an equal payload stands under a smaller page_id),
and a metadata record that alone holds the page_id. Request and metadata name the response in WARC-Concurrent-To. Reading
cuts the archives into records by their Content-Length, checks the digests, joins the records of a capture by those identifiers, whichever side states them,
and emits one nested row for it. Revisits are resolved by payload digest (the identical-payload-digest profile).

Which pages are revisits is found on (digest, page_id) alone; the payloads are shuffled once, by page_id, into files of about `file_bytes`, record after record,
by Spark's text writer to any file system it reaches, compressed by gzip. A reader unpacks a file as a stream and holds its compressed bytes and one batch of records.
Record identifiers are digests of page_id, url, payload digest and row number.

Defined cases. Null html: empty payload. Null page_id: a response of its own, page_id null. Rows that repeat page_id and payload: all
responses (none has a smaller id). Null url: no target URI; line breaks in an url are percent-encoded. Empty table: an archive without records, and no rows.
An archive cut short: its last, incomplete record is left out. A record without a type, identifier or length is left out. Request or metadata without an answer: no capture.
Several of them for one answer: all are listed. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, shared_dir, staged

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_sha1(digits: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 20 bits, so four letters, of every five digits."""
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    out = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(digits, i + 1, 5), 16, 10).cast("int")
        out += [letters[F.shiftright(bits, s).bitwiseAND(31)] for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, path: str, file_bytes: int = 256 << 20) -> None:
    """Archives of pages(page_id, url, html) under path, of about file_bytes of payload, or less so that all cores have work."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"))
    page = page.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    seen = staged(page.filter("page_id IS NOT NULL").select("page_id", "sha", F.octet_length("html").cast("long").alias("bytes")), "warc-digests")
    total = seen.agg(F.coalesce(F.sum(F.col("bytes") + 1024), F.lit(0))).first()[0]
    shared = seen.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = seen.join(shared, "sha").filter("page_id > first").select("page_id", "sha").distinct().withColumn("revisit", F.lit(True))
    cores = page.sparkSession.sparkContext.defaultParallelism
    files = max(1, -(-total // file_bytes), min(2 * cores, -(-total // (4 << 20))))
    # One shuffle of the payloads, for the join and the files alike. Null ids never revisit and stay where they are, so that no task gathers them.
    named = page.filter("page_id IS NOT NULL").repartition(files, "page_id", "sha").join(again, ["page_id", "sha"], "left")
    page = named.unionByName(page.filter("page_id IS NULL"), allowMissingColumns=True)
    name = F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), "url", "sha", F.monotonically_increasing_id().cast("string")).cast("binary"), 512)
    page = page.select("page_id", "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), base32_of_sha1(F.col("sha")).alias("digest"), name.alias("name"))
    for i, which in enumerate(("response_id", "request_id", "metadata_id")):
        page = page.withColumn(which, F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring("name", 32 * i + a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    uri = ("WARC-Target-URI", F.col("url"))
    answer = _record(
        [("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("response_id")), ("WARC-Date", DATE), uri,
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", F.when(F.col("revisit"), PROFILE)), ("Content-Type", "application/http;msgtype=response")],
        F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html"))),
    )
    asked = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", F.col("request_id")), ("WARC-Date", DATE), uri, ("WARC-Concurrent-To", F.col("response_id")), ("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    told = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", F.col("metadata_id")), ("WARC-Date", DATE), uri, ("WARC-Concurrent-To", F.col("response_id")), ("Content-Type", "application/warc-fields")],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    page.select(F.explode(F.array(asked, answer, told)).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    discard(seen)


RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("concurrent_to", T.ArrayType(T.StringType())), T.StructField("uri", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("digest_ok", T.BooleanType()), T.StructField("payload_bytes", T.LongType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()),
])


def _base32(payload: bytes) -> str:
    import base64

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Unpacked:
    """A gzip file of one or many members, read as a stream; one cut short or followed by other bytes ends where it can be read no further."""

    def __init__(self, content: bytes) -> None:
        self.content, self.at, self.member = content, 0, zlib.decompressobj(31)

    def read(self, most: int) -> bytes:
        while True:
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
            chunk = self.member.unconsumed_tail
            if not chunk:
                chunk = self.content[self.at : self.at + (1 << 16)]
                self.at += len(chunk)
            if not chunk:
                return b""
            try:
                out = self.member.decompress(chunk, most)
            except zlib.error:
                return b""
            if out:
                return out


def parse(stream: BinaryIO | Unpacked, most: int = 1 << 20) -> Iterator[dict]:
    """The records of an archive, by Content-Length; a header of over `most` bytes is no header."""
    held = b""

    def more() -> bool:
        nonlocal held
        new = stream.read(1 << 20)
        held += new
        return bool(new)

    while True:
        start = held.find(b"WARC/1.")
        if start < 0:
            held = held[-6:]
            if not more():
                return
            continue
        held = held[start:]
        while (head_end := held.find(b"\r\n\r\n")) < 0 and len(held) < most and more():
            pass
        if head_end < 0:
            held = held[7:]
            continue
        headers: dict[str, list[str]] = {}
        for line in held[:head_end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.decode("utf-8", "replace").strip().lower(), []).append(value.strip().decode("utf-8", "replace"))
        first = lambda name: headers.get(name, [None])[0]
        length = first("content-length") or ""
        if not (length.isascii() and length.isdigit() and first("warc-type") and first("warc-record-id")):
            held = held[head_end:]
            continue
        end = head_end + 4 + int(length)
        if len(held) < end:
            parts, size = [held], len(held)
            while size < end and (new := stream.read(1 << 20)):
                parts.append(new)
                size += len(new)
            held = b"".join(parts)
            if len(held) < end:
                return
        yield _record_of(first, headers, held[head_end + 4 : end])
        held = held[end:]


def _record_of(first: Callable[[str], str | None], headers: dict[str, list[str]], block: bytes) -> dict:
    kind = first("warc-type")
    digest = (first("warc-payload-digest") or "").removeprefix("sha1:") or None
    out = {"record_id": first("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to", []), "uri": first("warc-target-uri"), "payload_digest": digest, "digest_ok": None, "payload_bytes": None, "fields": {}, "payload": None}
    if kind in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        out["payload_bytes"] = int(sizes[0]) if sizes and sizes[0].isdigit() else len(body)
        if kind == "response":
            out["payload"], out["digest_ok"] = body, digest == _base32(body) and out["payload_bytes"] == len(body)
    elif kind == "metadata":
        out["fields"] = {k.decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in block.split(b"\r\n") if x)}
    return out


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under path; payload null unless payloads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows: list[dict] = []
                size = 0
                for r in parse(Unpacked(content) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    size += 256 + len(r["payload"] or b"")
                    if size > 1 << 22:
                        yield pd.DataFrame(rows, columns=RECORD.names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=RECORD.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per answer: record_id, response (struct), requests and metadata (arrays of structs by id, empty if missing).

    A request or metadata record belongs to the answers that it names in Concurrent-To, and to those that name it.
    """
    is_answer = F.col("type").isin("response", "revisit")
    answer = records.filter(is_answer).select("record_id", F.struct("type", "uri", "payload_digest", "digest_ok", "payload_bytes", "payload").alias("response"))
    others = records.filter(~is_answer)
    names_it = records.filter(is_answer & (F.size("concurrent_to") > 0)).select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id"))
    said = others.select(F.explode("concurrent_to").alias("capture"), "record_id").unionByName(names_it.select("capture", "record_id")).distinct()
    body = others.select("record_id", "type", F.struct(F.col("record_id").alias("id"), "uri", "fields").alias("body"))
    kept = said.join(body, "record_id")
    of = lambda kind, *fields: F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", F.map_entries("body.fields").alias("entries"), F.col("body.uri").alias("uri"))))), lambda x: F.struct(x["record_id"].alias("id"), *[f(x) for f in fields]))
    gathered = kept.groupBy(F.col("capture").alias("record_id")).agg(
        of("request", lambda x: x["uri"].alias("uri")).alias("requests"), of("metadata", lambda x: F.map_from_entries(x["entries"]).alias("fields")).alias("metadata"),
    )
    none = lambda c: F.coalesce(c, F.filter(c, lambda x: F.lit(False)), F.array().cast(gathered.schema[c].dataType))
    return answer.join(gathered, "record_id", "left").withColumns({c: none(c) for c in ("requests", "metadata")})


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """captures() of pages written to the shared folder and read back, with page_id and refers_to; without payloads the archives are parsed once."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    records = read(spark, path, payloads) if payloads else staged(read(spark, path, False), "warc-records")
    found = captures(records).withColumn("page_id", F.get("metadata", 0)["fields"]["page-id"].cast("long"))
    first = found.filter("response.type = 'response'").groupBy(F.col("response.payload_digest").alias("digest")).agg(F.min("page_id").alias("first"))
    revisit = F.col("response.type") == "revisit"
    return found.join(first, F.col("response.payload_digest") == F.col("digest"), "left").withColumn("refers_to", F.when(revisit, F.col("first"))).drop("digest", "first")
