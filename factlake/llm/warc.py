"""WARC archives: writing captures with revisits, reading, and assembling transactions."""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.storage import bit_filter, hot_keys, join_dealt, maybe_in, read_table, rename_files, save, scratch_folder

EOL = "\r\n"
#: Payloads from this many bytes on are stored once.
LEAST_REVISIT = 100
#: Compressed bytes of an archive file beyond which another is begun.
FILE_BYTES = 1 << 25
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(kind: str, *parts: Column) -> Column:
    """A UUID from a digest of what the record stands for."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record up to the two line ends that close it; null fields are left out."""
    lines = [F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}")]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit("")) for name, value in fields]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL), block)


def member(record: bytes) -> bytes:
    """A record and the two line ends that close it as a gzip member of its own."""
    zipper = zlib.compressobj(1, wbits=31)
    return zipper.compress(record) + zipper.compress(b"\r\n\r\n") + zipper.flush()


def _members(records: DataFrame, date: str) -> DataFrame:
    """(volume, seq, member) of ``records(record)``: a volume is a file, and begins with a warcinfo record."""

    def info(volume: int) -> bytes:
        body = b"software: factlake\r\nformat: WARC File Format 1.1\r\n"
        name = hashlib.md5(f"{TaskContext.get().partitionId()}|{volume}".encode()).hexdigest()
        name = f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {name}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        return member(head.encode() + body)

    def run(batches):
        volume, held, seq = -1, FILE_BYTES, 0
        for batch in batches:
            rows, size = [], 0
            for text in batch.column(0).cast(pa.large_binary()):
                packed = member(text.as_py())
                if held >= FILE_BYTES:
                    volume, held = volume + 1, 0
                    rows.append((volume, seq, info(volume)))
                    seq += 1
                rows.append((volume, seq, packed))
                seq, held, size = seq + 1, held + len(packed), size + len(packed)
                if size > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["volume", "seq", "member"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["volume", "seq", "member"])

    return records.mapInArrow(run, "volume int, seq long, member binary")


def _write_files(members: DataFrame, path: str) -> None:
    """Write the members one after another as files ``part-..warc.gz``.

    Spark's text writer puts one byte between rows. A member ends in the
    highest byte of its length, 0 below 16 MB: that byte is left to the writer.
    A larger record is followed by an empty member, which ends in 0.
    """
    empty = F.lit(zlib.compressobj(1, wbits=31).flush())
    whole = F.when(F.substring("member", -1, 1) == F.lit(b"\x00"), F.col("member")).otherwise(F.concat("member", empty))
    lines = members.sortWithinPartitions("volume", "seq").select("volume", F.substring(whole, F.lit(1), F.octet_length(whole) - 1).cast("string").alias("value"))
    lines.write.partitionBy("volume").option("lineSep", "\u0000").option("compression", "none").text(path)
    rename_files(members.sparkSession, path, ".txt", ".warc.gz")


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write request, response (or revisit) and metadata records of each row of ``pages(page_id, url, html)``.

    The records of a row follow each other; request and metadata name the
    response in WARC-Concurrent-To. Of equal payloads of LEAST_REVISIT bytes
    or more the row with the smallest page_id is the response (null last; rows
    that repeat it are responses too), others are revisits of it. Each record
    is a gzip member, files begin with a warcinfo record and end once they
    have FILE_BYTES.

    A revisit holds no payload, so copies are found and written without their
    html. The html of a row that may be a copy is shuffled only if a filter of
    the copies' rows takes it for one.
    """
    pages = pages.select(
        "page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row")
    )
    pages = save(pages.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256)))
    narrow = pages.drop("html")
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "row"))
    copies = narrow.where(f"bytes >= {LEAST_REVISIT}").groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    copies = save(copies.where("n > 1").select("digest", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")))
    hits = save(maybe_in(narrow, "digest", bit_filter(copies, "digest")))
    again = save(join_dealt(hits, copies, "digest", by=["row"]).where("not (page_id <=> first_page)"))
    seen = bit_filter(again, "row")
    # Rows that the filter takes for copies and that aren't.
    taken = save(maybe_in(narrow.select("row"), "row", seen).join(again.select("row"), "row", "left_anti"))
    others = maybe_in(maybe_in(pages, "row", seen), "row", bit_filter(taken, "row")).join(taken, "row", "left_semi")
    responses = maybe_in(pages, "row", seen, negate=True).unionByName(others.select(pages.columns))

    def records(rows: DataFrame, revisit: bool) -> DataFrame:
        own = record_id("response", F.col("page_id"), F.col("row"))
        stamp, uri = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))
        digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
        http = F.concat(
            F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL)
        )
        reply = ("Content-Type", F.lit("application/http; msgtype=response"))
        if revisit:
            refers = record_id("response", F.col("first_page"), F.col("first_row"))
            answer = record("revisit", [("WARC-Record-ID", own), stamp, uri, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers), reply], http)
        else:
            answer = record("response", [("WARC-Record-ID", own), stamp, uri, digest, reply], F.concat(http, "html"))
        request = record(
            "request",
            [("WARC-Record-ID", record_id("request", F.col("page_id"), F.col("row"))), ("WARC-Concurrent-To", own), stamp, uri, ("Content-Type", F.lit("application/http; msgtype=request"))],
            F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{EOL}{EOL}")),
        )
        fields = F.concat(
            F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(EOL)), F.lit("")), F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(EOL)
        )
        metadata = record(
            "metadata",
            [("WARC-Record-ID", record_id("metadata", F.col("page_id"), F.col("row"))), ("WARC-Concurrent-To", own), stamp, uri, ("Content-Type", F.lit("application/warc-fields"))],
            fields,
        )
        return rows.select(F.explode(F.array(request, answer, metadata)).alias("record"))

    _write_files(_members(records(responses, False).unionByName(records(again, True)), date), path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


RECORDS = pa.schema(
    [(n, pa.string()) for n in ("kind", "id", "concurrent_to", "refers_to", "uri", "date", "digest")]
    + [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the WARC files below ``path`` (gzip or plain).

    payload_bytes and payload_sha256 are taken from the bytes of a response's
    body; ``fields`` are a metadata record's. With ``payload`` false the bytes
    themselves stay behind.
    """
    schema = "kind string, id string, concurrent_to string, refers_to string, uri string, date string, digest string, payload_bytes long, payload_sha256 string, fields map<string,string>, payload binary"

    def rows(content: bytes) -> Iterator[tuple]:
        plain = io.BytesIO(content)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=plain)) if content[:2] == b"\x1f\x8b" else plain
        for head, block in parse(stream):
            kind, body, notes = head.get("warc-type"), None, None
            if kind == "response":
                body = block.partition(b"\r\n\r\n")[2]
            elif kind == "metadata":
                notes = [tuple(x.strip() for x in line.partition(":")[::2]) for line in block.decode("utf-8", "replace").splitlines() if ":" in line]
            yield (
                kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"),
                head.get("warc-payload-digest"), None if body is None else len(body), None if body is None else hashlib.sha256(body).hexdigest(), notes, body if payload else None,
            )

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                part, held = [], 0
                for row in rows(content.as_py()):
                    part.append(row)
                    held += len(row[-1] or b"")
                    if len(part) >= 5000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), RECORDS, strict=True)], schema=RECORDS)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), RECORDS, strict=True)], schema=RECORDS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with the request and
    metadata records that name it in WARC-Concurrent-To, and the response that
    a revisit refers to. Records without a capture are left out; a capture
    without requests or metadata has empty arrays."""
    captures = records.where("kind in ('response', 'revisit')").select(
        "id", "refers_to", F.struct("kind", "id", "refers_to", "uri", "date", "digest", "payload_bytes", "payload_sha256", "payload").alias("response")
    )
    others = records.where("kind in ('request', 'metadata') and concurrent_to is not null")
    others = others.groupBy(F.col("concurrent_to").alias("id")).agg(
        F.collect_list(F.when(F.col("kind") == "request", F.struct("id", "uri", "date"))).alias("requests"),
        F.collect_list(F.when(F.col("kind") == "metadata", F.struct("id", "fields"))).alias("metadata"),
    )
    found = captures.join(others, "id", "left")
    first = F.col("metadata")[0]["fields"]
    found = found.withColumn("page_id", first["page-id"].cast("long")).withColumn("payload_bytes", first["payload-bytes"].cast("long"))
    # Only records that refer to another are joined: the others would meet under one null key.
    columns = ["page_id", "payload_bytes", "refers_to_page", "response", "requests", "metadata"]
    referred = found.where("response.kind = 'response'").select(F.col("id").alias("refers_to"), F.col("page_id").alias("refers_to_page"))
    hot = hot_keys(records.where("kind in ('response', 'revisit')"), "refers_to")
    again = join_dealt(found.where("refers_to is not null"), referred, "refers_to", "left", hot, by=["id"]).select(columns)
    return again.unionByName(found.where("refers_to is null").withColumn("refers_to_page", F.lit(None).cast("long")).select(columns))


def round_trip(pages: DataFrame, payload: bool = True) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives, read them back and assemble the captures.

    A null html is an empty payload and always a response; a null url leaves
    out the target; a null page_id comes back as null. Repeated rows are
    captures of their own. An empty table gives an empty result; other columns
    are ignored. A very long payload is one record, held whole by one task; a
    file that holds it ends there.
    """
    path = scratch_folder(pages.sparkSession)
    write_archives(pages, path)
    return assemble(save(read_archives(pages.sparkSession, path, payload)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = round_trip(read_table(spark, sf_dir, "pages"), payload=False)
    digest = F.coalesce("response.payload_sha256", F.regexp_extract("response.digest", "([0-9a-f]{64})", 1))
    return captures.select(
        "page_id", F.coalesce("response.payload_bytes", "payload_bytes").alias("payload_bytes"), digest.alias("payload_digest"),
        F.col("response.kind").alias("record_type"), F.col("refers_to_page").alias("refers_to"),
    )


ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, p.n as payload_bytes, p.d as payload_digest,
  case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end as record_type,
  case when f.first <> p.page_id then f.first end as refers_to
from p left join f on f.d = p.d
"""
