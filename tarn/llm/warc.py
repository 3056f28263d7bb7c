"""WARC archives: captures written as request, response or revisit, and metadata records, read and assembled again.

Writing makes a gzip member of each record and whole archives of the members in tasks, and hands each archive to Spark's
writer as one row, so archives land wherever Spark can write. Reading takes whole files (bounded in bytes and records when
written here) and cuts them by Content-Length. Assembly joins records through WARC-Concurrent-To, whichever of them names
the other, and gives one nested row for each capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import bound_batches, fresh_path, written

#: Records of one archive file at most, and compressed bytes from which on it is closed: a file is small enough for a task.
FILE_RECORDS, FILE_BYTES = 10_000, 16 << 20
#: Requests and metadata records in one row of a capture, about; what a capture has beyond goes into rows of their own.
ATTACHED = 10_000
EOL = "\r\n"
#: What closes a record.
END = b"\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("block", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("digest_ok", T.BooleanType()),
    ]
)


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of a string's SHA-1: five hexadecimal digits are four letters."""
    digest = F.sha1(text.cast("binary"))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, shift: F.substring(F.lit(ALPHABET), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(*(letter(v, s) for s in (15, 10, 5, 0)))), "")


def _urn(*parts: Column) -> Column:
    x = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[p for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for p in ([F.lit("-")] if a > 1 else []) + [F.substring(x, a, n)]], F.lit(">"))


def _record(kind: Column | str, record_id: Column, uri: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """One record without its closing line ends. Headers whose value is null are left out; line ends in values are encoded."""
    clean = lambda v: F.regexp_replace(v, r"[\x00-\x1f\x7f]", "%20")
    lines = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit("2024-01-01T00:00:00Z")), ("WARC-Target-URI", clean(uri)), *headers, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(EOL, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in lines]), F.lit(EOL * 2), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> str:
    """Writes gzipped WARC files, a member for each record, three records for each row of ``pages``, and returns ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the largest id are responses, the others
    revisits without a payload that refer to the first of these. A null payload is empty; a null URI leaves its header
    out; a null id is smaller than any other. Repeated rows are captures of their own: of wholly equal rows with the
    largest id each is a response. An empty table gives archives without records. A very long page is a record like any
    other and closes its archive; a record has to fit Spark's 2 GB for a value. Further columns play no part.
    """
    bound_batches(pages.sparkSession, 128)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload"), F.octet_length(payload).alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("key"), F.monotonically_increasing_id().alias("nth"))
    rows = rows.withColumn("capture", F.concat_ws("-", F.col("id").cast("string"), F.col("nth").cast("string")))
    # The narrow table is grouped, with maxima in the tasks first, and written: the join with the wide one then reads two
    # plain tables, and Spark can split the partition of a payload that very many pages share.
    best = written(rows.groupBy("key").agg(F.max(F.struct("id", "capture")).alias("best")), "payloads")
    paired = rows.join(best, "key")
    first = F.col("id").eqNullSafe(F.col("best.id")) | (F.col("bytes") < least_bytes)
    response_id = _urn(F.col("capture"), F.lit("response"))
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL * 2))
    profile = F.when(~first, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    response = _record(
        F.when(first, F.lit("response")).otherwise(F.lit("revisit")), response_id, F.col("uri"),
        [("WARC-Payload-Digest", digest), ("WARC-Profile", profile), ("WARC-Refers-To", F.when(~first, _urn(F.col("best.capture"), F.lit("response"))))],
        "application/http;msgtype=response", F.when(first, F.concat(head, F.col("payload"))).otherwise(head),
    )
    link = [("WARC-Concurrent-To", response_id)]
    ask = F.concat(F.lit("GET "), F.coalesce(F.regexp_extract(F.col("uri"), r"^[a-z]+://[^/?#]*([^#\s]*)", 1), F.lit("/")), F.lit(f" HTTP/1.1{EOL}Host: "), F.coalesce(F.regexp_extract(F.col("uri"), r"^[a-z]+://([^/?#\s]*)", 1), F.lit("")), F.lit(EOL * 2))
    request = _record("request", _urn(F.col("capture"), F.lit("request")), F.col("uri"), link, "application/http;msgtype=request", ask)
    fields = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(EOL)), F.lit(f"charset-for-links: utf-8{EOL}"))
    metadata = _record("metadata", _urn(F.col("capture"), F.lit("metadata")), F.col("uri"), link, "application/warc-fields", fields)
    records = paired.select(F.explode(F.array(request, response, metadata)).alias("value"))
    archives = records.mapInArrow(partial(_archives, file_bytes=file_bytes), "content binary").select(F.col("content").cast("string"))
    # A row is an archive without its last byte, which is 0: Spark writes it as the row's end.
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def _archives(batches: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Whole archives, each without the 0 it ends with, of the records in the batches; one is closed at ``file_bytes``."""
    members: list[bytes] = []
    held = 0

    def closed() -> pa.RecordBatch:
        # The last byte of a member is the highest of its record's size; beyond 16 MB an empty member gives the 0.
        content = b"".join(members) + (b"" if members[-1].endswith(b"\0") else gzip.compress(b"", mtime=0))
        return pa.RecordBatch.from_arrays([pa.array([content[:-1]], pa.binary())], names=["content"])

    for batch in batches:
        for record in batch.column(0).cast(pa.binary()):
            members.append(gzip.compress(record.as_py() + END, 4, mtime=0))
            held += len(members[-1])
            if len(members) >= FILE_RECORDS or held >= file_bytes:
                yield closed()
                members, held = [], 0
    if members:
        yield closed()


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, gzipped or not. A cut-off file is an error."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield headers, block


def read_records(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``, with RECORD's columns.

    payload_bytes and payload_digest (base32 SHA-1) are of the payload as read; a revisit has none, and keeps the digest
    of its header. digest_ok tells whether header and payload agree (null without a header). ``payloads=False`` leaves
    out the bytes themselves. The block is kept for metadata and request records.
    """
    bound_batches(spark, 16)
    arrow = to_arrow_schema(RECORD)
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                for headers, block in parse_archive(batch.column(0)[i].as_py()):
                    one = lambda name, h=headers: h.get(name, [None])[0]
                    kind, told = one("warc-type"), one("warc-payload-digest")
                    told = told.partition(":")[2] if told else None
                    http = (one("content-type") or "").startswith("application/http")
                    payload = (block.partition(b"\r\n\r\n")[2] if http else block) if kind in ("response", "resource") else None
                    digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append(
                        {
                            "record_id": one("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
                            "target_uri": one("warc-target-uri"), "date": one("warc-date"), "block": block if kind in ("request", "metadata") else None, "payload": payload if payloads else None,
                            "payload_bytes": None if payload is None else len(payload), "payload_digest": digest or told, "digest_ok": None if digest is None or told is None else digest == told,
                        }
                    )
                    held += len(block) if payloads else 400
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(parse, RECORD)


def assemble(records: DataFrame, attached: int = ATTACHED) -> DataFrame:
    """One nested row for each capture: capture_id, part, response, requests, metadata.

    A capture is a response, revisit or resource record and what is concurrent to it: requests and metadata that name
    it, that it names, or that name a record which is concurrent to it in one of these two ways. A request or metadata
    record that could belong to several captures goes to the one with the smallest id; without a capture it forms a row of
    its own, whose response is null. Repeated response ids give a row each. ``requests`` and ``metadata`` are arrays of
    records, in order of their ids; null ids or links join nothing. A capture to which more than ``attached`` records
    belong has further rows, with the others and no response, numbered by ``part``: no row and no task gathers more than
    about so many. No records give no rows. ``records`` is read several times: pass a written table.
    """
    main = records.where(F.col("type").isin("response", "revisit", "resource"))
    rest = records.where(F.col("type").isin("request", "metadata")).withColumn("nth", F.monotonically_increasing_id())
    named = rest.select("record_id", F.explode("concurrent_to").alias("other"))
    # Very many records may name one. This join has two plain sides, and grouped sides are written: Spark can split both.
    direct = named.join(main.select(F.col("record_id").alias("other")), "other", "left_semi").select("record_id", F.col("other").alias("capture_id"))
    naming = main.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id")).select("record_id", "capture_id")
    near = written(direct.unionByName(naming).groupBy("record_id").agg(F.min("capture_id").alias("capture_id")), "near")
    through = named.join(near.withColumnRenamed("record_id", "via"), F.col("other") == F.col("via")).select("record_id", "capture_id")
    home = written(near.unionByName(through).groupBy("record_id").agg(F.min("capture_id").alias("capture_id")), "home")
    placed = rest.join(home, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", "record_id"))
    crowded = written(placed.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > attached), "crowded")
    part = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("nth"), F.ceil(F.col("n") / attached))).cast("int")
    record = F.struct(*[c for c in records.columns if c not in ("payload", "payload_bytes", "payload_digest", "digest_ok")])
    own = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("record"))))
    around = (
        placed.withColumn("record", record)
        .join(crowded, "capture_id", "left")
        .select("capture_id", part.alias("part"), "type", "record")
        .groupBy("capture_id", "part")
        .agg(own("request").alias("requests"), own("metadata").alias("metadata"))
    )
    response = main.select(F.col("record_id").alias("capture_id"), F.lit(0).alias("part"), F.struct(*records.columns).alias("response"))
    return response.join(around, ["capture_id", "part"], "full").select("capture_id", "part", "response", "requests", "metadata")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives, read back and assembled: one row for each page."""
    path = write_captures(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    captures = assemble(written(read_records(spark, path, payloads=False), "records"))
    page_id = F.regexp_extract(F.decode(F.get(F.col("metadata"), F.lit(0))["block"], "UTF-8"), r"page-id: (-?\d+)", 1)
    flat = written(
        captures.select("capture_id", F.when(page_id != "", page_id).cast("long").alias("page_id"), *[F.col(f"response.{c}").alias(c) for c in ("type", "refers_to", "payload_bytes", "payload_digest")]), "captures"
    )
    first = flat.where("type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("first_id"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    again = flat.where("type = 'revisit'").drop("payload_bytes", "payload_digest").join(first, "refers_to")
    columns = lambda df, size, digest, refers: df.select("page_id", F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), F.col("type").alias("record_type"), refers.alias("refers_to"))
    return columns(flat.where("type = 'response'"), "payload_bytes", "payload_digest", F.lit(None).cast("long")).unionByName(columns(again, "first_bytes", "first_digest", F.col("first_id")))


OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS best,
         list_aggregate(list_transform(range(32), lambda i: substr('{ALPHABET}', 1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""
