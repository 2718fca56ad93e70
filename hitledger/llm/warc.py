"""WARC archives of pages: written by Spark, read back with segments reassembled.

A page is a ``response`` record: HTTP headers and its payload in chunked transfer framing. A block longer than a segment is cut: the
record holds segment 1, ``continuation`` records hold the others, each with the first one's id (WARC-Segment-Origin-ID) and its
number, the last with the total length. A ``revisit`` record has no payload; it names the response whose payload is equal.

Records are text to Spark: every one is a row of its text writer with the record's final line breaks as line separator, so
archives (gzip files) are committed like any other output, and to any store. Segments, chunks and header lines are cut between characters.
Reading unpacks an archive in a task, record by record; its size is what ``archive_bytes`` set, as long pages are cut. Segments meet by
origin in one shuffle, wherever they lie; unsegmented records are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hitledger.llm.common import joined_back, text_or_empty, written

SEGMENT, CHUNK, ARCHIVE_BYTES = 16_384, 4_096, 32_000_000
NEWLINE = "\r\n"
# Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_32, BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = ("record_id string, type string, uri string, page_id long, payload_digest string, refers_to string, segment int, origin string, "
          "total_length long, block binary, problem string")


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of bytes: 5 bytes are 8 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), HEX_32, BASE_32)


def _cuts(text: Column, every: int) -> Column:
    """The pieces of a binary column, cut before the character that holds each ``every``-th byte; an empty array for an empty one."""
    def edge(at: Column) -> Column:
        """The last place up to ``at`` where no character is open: a character has four bytes at most."""
        def open_(i: int) -> Column:
            return F.conv(F.hex(F.substring(text, at + 1 - i, F.lit(1))), 16, 10).cast("int").between(128, 191)
        place = at - F.when(~open_(0), 0).when(~open_(1), 1).when(~open_(2), 2).when(~open_(3), 3).otherwise(0)
        return F.when(at >= F.octet_length(text), F.octet_length(text)).when(at <= 0, 0).otherwise(place)

    starts = F.sequence(F.lit(0).cast("int"), F.greatest(F.octet_length(text) - 1, F.lit(0)), F.lit(every))
    return F.when(F.octet_length(text) == 0, F.array().cast("array<binary>")).otherwise(F.transform(
        starts, lambda at: F.substring(text, edge(at) + 1, edge(at + every) - edge(at))))


def _joined(parts: list[Column | str | bytes]) -> Column:
    """Binary concatenation."""
    return F.concat(*[(F.lit(p) if isinstance(p, (str, bytes)) else p).cast("binary") for p in parts])


def _all(pieces: Column) -> Column:
    """Binary concatenation of an array's items. Strings of Spark are bytes: nothing is decoded."""
    return F.array_join(F.transform(pieces, lambda p: p.cast("string")), "").cast("binary")


def chunked(payload: Column, chunk: int = CHUNK) -> Column:
    """A binary column in chunked transfer framing."""
    framed = F.transform(_cuts(payload, chunk), lambda c: _joined([F.lower(F.hex(F.octet_length(c))), NEWLINE, c, NEWLINE]))
    return _joined([_all(framed), "0" + NEWLINE + NEWLINE])


def _uuid(seed: Column) -> Column:
    digest = F.md5(seed)
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(digest, i, n), F.lit("-"))],
                    F.substring(digest, 21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. Line breaks in values become spaces."""
    plain = F.regexp_replace(value.cast("string"), r"[\r\n]", " ")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), plain, F.lit(NEWLINE))).otherwise("")


def capture(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """The rows (page_id, url, html) of ``pages``, a written table: page_id, url, payload (binary), payload_digest, row, type, refers_row,
    refers_id, refers_url.

    Of rows with equal payloads of ``at_least`` bytes or more, one with the largest page_id is a response (a null page_id is less than any;
    of several rows that share it, one), and the others revisit it. Shorter payloads are all responses. Null html is an
    empty payload. Payloads are equal if SHA-256 and length are. Other columns are not read; an empty table gives an empty result.
    """
    payload = text_or_empty("html").cast("binary")
    rows = written(pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("payload_digest"), F.sha2(
        payload, 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "pages")
    narrow = rows.filter(F.octet_length("payload") >= at_least).select("sha", F.octet_length("payload").alias("n"), "page_id", "row", "url")
    first = F.max(F.struct("page_id", (-F.col("row")).alias("row"))).alias("first")
    groups = narrow.groupBy("sha", "n").agg(F.count("*").alias("copies"), first).filter("copies > 1").select(
        "sha", "n", (-F.col("first.row")).alias("refers_row"), F.col("first.page_id").alias("refers_id"))
    groups = written(groups, "equal")
    chosen = groups if groups.count() > 100_000 else F.broadcast(groups)  # 100 bytes each; else Spark shuffles, no group's rows meeting in one
    found = rows.withColumn("n", F.octet_length("payload")).join(chosen, ["sha", "n"], "left")
    revisit = F.col("refers_row").isNotNull() & (F.col("refers_row") != F.col("row"))
    return found.select("page_id", "url", "payload", "payload_digest", "row", F.when(revisit, "revisit").otherwise("response").alias("type"),
                        F.when(revisit, F.col("refers_row")).alias("refers_row"), F.when(revisit, F.col("refers_id")).alias("refers_id"))


def records(captured: DataFrame, date: str, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """(record: binary) WARC records of captured pages without the two line breaks that end each."""
    http = F.when(F.col("type") == "response", _joined([
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n", chunked(F.col("payload"), chunk)])).otherwise(
        _joined(["HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"]))
    framed = captured.withColumn("block", http).drop("payload")
    cut = framed.withColumn("total", F.octet_length("block")).withColumn("parts", _cuts(F.col("block"), segment)).drop("block")
    # No block is empty. The inner form would have Spark filter on the cut block beneath all steps that make it.
    each = cut.select("*", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("i", "part")).drop("parts")
    own, many, first, last = _record_id("row"), F.col("n") > 1, F.col("i") == 0, F.col("i") == F.col("n") - 1
    number = F.col("i") + 1
    head = F.concat(
        F.lit(VERSION + NEWLINE), _line("WARC-Type", F.when(first, F.col("type")).otherwise("continuation")),
        _line("WARC-Record-ID", F.when(first, own).otherwise(_uuid(F.concat(F.col("row"), F.lit("/"), number)))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("Content-Type", F.when(first, "application/http; msgtype=response")),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "payload_digest"))),
        _line("WARC-Profile", F.when(first & (F.col("type") == "revisit"), REVISIT_PROFILE)),
        _line("WARC-Refers-To", F.when(first & F.col("refers_row").isNotNull(), _record_id("refers_row"))),
        _line("WARC-Segment-Number", F.when(many, number)), _line("WARC-Segment-Origin-ID", F.when(many & ~first, own)),
        _line("WARC-Segment-Total-Length", F.when(many & last, F.col("total"))), _line("Page-Id", F.when(first, F.col("page_id"))),
        _line("Content-Length", F.octet_length("part")))
    return each.select(_joined([head, NEWLINE, F.col("part")]).alias("record"))


def _record_id(row: str) -> Column:
    return _uuid(F.concat(F.lit("page/"), F.col(row).cast("string")))


def write_archives(captured: DataFrame, path: str, date: str = "2024-01-31T00:00:00Z", segment: int = SEGMENT, chunk: int = CHUNK,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC files (gzip) of ``capture``'s rows at ``path``, each of some ``archive_bytes`` before compression.

    Rows stay in the tasks that read them; a file is closed after as many records as fill it if all are as long as a segment.
    """
    made = records(captured, date, segment, chunk).select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", 2 * NEWLINE).option("compression", "gzip").option(
        "maxRecordsPerFile", max(1, archive_bytes // segment)).text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def _parse(stream) -> Iterator[tuple]:
    """The records of an uncompressed archive as tuples of RECORD; the last one tells what is wrong if the archive is damaged."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            yield (*[None] * 10, "no record where one should start")
            return
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        if not re.fullmatch("[0-9]+", head.get("content-length", "")):
            yield (*[None] * 10, "a record without a length")
            return
        length = int(head["content-length"])
        block = stream.read(length)
        number, total, page = (int(head[k]) if re.fullmatch("-?[0-9]+", head.get(k, "")) else None
                               for k in ("warc-segment-number", "warc-segment-total-length", "page-id"))
        digest = head.get("warc-payload-digest")
        yield (head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), page, digest and digest.removeprefix("sha1:"),
               head.get("warc-refers-to"), number, head.get("warc-segment-origin-id"), total, block,
               None if len(block) == length else "the archive ends inside a record")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip
    import io
    import zlib

    types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def found(content: bytes) -> Iterator[tuple]:
        stream = io.BytesIO(content)
        try:
            yield from _parse(gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream)
        except (EOFError, OSError, zlib.error) as e:
            yield (*[None] * 10, f"unreadable archive: {type(e).__name__}")

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            held, size = [], 0
            for record in found(batch["content"][i].as_py()):
                held.append(record)
                size += len(record[9] or b"")
                if size > 4_000_000:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives at ``path``, segments as they lie there. A damaged archive gives the records before the damage and
    a row with ``problem``."""
    archives = spark.read.format("binaryFile").load(path)
    return archives.select("content").mapInArrow(_read, RECORD)


def reassembled(found: DataFrame) -> DataFrame:
    """Whole records: continuations joined to their origin in order of number, their count, numbers and total length verified.

    ``problem`` says what is missing; the block is then null. Continuations without an origin give a row with a problem, too.
    """
    alone = found.filter("segment IS NULL").drop("segment", "origin", "total_length")
    parts = found.filter("segment IS NOT NULL").withColumn("of", F.coalesce("origin", "record_id"))
    pieces = F.sort_array(F.collect_list(F.struct("segment", "block")))
    firsts = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_id", "type", "uri", "page_id", "payload_digest", "refers_to")]
    grouped = parts.groupBy("of").agg(*firsts, pieces.alias("pieces"), F.max("total_length").alias("total"), F.count("total_length").alias("ends"),
                                      F.max("problem").alias("broken"))
    n = F.size("pieces")
    length = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + F.octet_length(p["block"]))
    problem = (F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("record_id").isNull(), "no first segment")
               .when(F.col("ends") != 1, "not one last segment")
               .when((F.col("pieces")[n - 1]["segment"] != n) | (F.size(F.array_distinct("pieces.segment")) != n), "segments are missing or repeated")
               .when(length != F.col("total"), "segments do not have the total length"))
    whole = grouped.withColumn("problem", problem).select(
        F.coalesce("record_id", "of").alias("record_id"), "type", "uri", "page_id", "payload_digest", "refers_to",
        F.when(F.col("problem").isNull(), _all(F.col("pieces.block"))).alias("block"), "problem")
    return alone.unionByName(whole)


def dechunked(framed: bytes) -> bytes | None:
    """The payload of a chunked body, None if the framing is broken. Chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        size = framed[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(b"[0-9A-Fa-f]+", size):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(framed[end + 2:end + 2 + n])
        at = end + 2 + n
        if len(out[-1]) != n or framed[at:at + 2] != b"\r\n":
            return None
        at += 2


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, problems = [], batch["problem"].to_pylist()
        for i, block in enumerate(batch["block"].to_pylist()):
            head, _, body = (block or b"").partition(b"\r\n\r\n")
            if problems[i] or batch["type"][i].as_py() == "revisit":
                payloads.append(None)
                continue
            fields = {k.lower(): v.strip().lower() for k, v in _HEADER.findall(head.partition(b"\r\n")[2] + b"\r\n")}
            payloads.append(dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body)
            if payloads[i] is None:
                problems[i] = "broken chunks"
        keep = [c for c in batch.schema.names if c not in ("block", "problem")]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(payloads, pa.binary()), pa.array(problems, pa.string())],
                                         names=[*keep, "payload", "problem"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives at ``path``: record_id, type, uri, page_id, payload_digest, refers_to (a record id), payload, problem.

    Payloads are whole and unframed; those of revisits are null, as the archive does not repeat them. Records that are neither response nor
    revisit are passed over. An empty folder of archives gives an empty result.
    """
    whole = reassembled(read_records(spark, path)).filter("type IN ('response', 'revisit') OR problem IS NOT NULL")
    return whole.mapInArrow(_payloads, "record_id string, type string, uri string, page_id long, payload_digest string, refers_to string, "
                                       "payload binary, problem string")


def resolved(found: DataFrame) -> DataFrame:
    """``read_pages``'s rows as page_id, type, payload_bytes, payload_digest (of the payload read), refers_page and problem, revisits
    looked up in the responses they name.

    Rows that meet a response's are told by its record id; the aggregation holds one row a response, never its revisits.
    """
    response = F.col("type") == "response"
    own = written(found.select("page_id", "type", F.col("payload_digest").alias("told"), "problem", F.octet_length("payload").cast("long").alias(
        "own_bytes"), F.when(response, base32_sha1(F.col("payload"))).alias("own_digest"), F.coalesce("refers_to", "record_id").alias("response")), "captures")
    looked_up = [F.max(F.when(response, F.col(c))).alias(a) for c, a in (
        ("own_bytes", "payload_bytes"), ("own_digest", "payload_digest"), ("page_id", "response_page"))]
    named = own.filter("type = 'revisit'").select("response").distinct()
    joined = joined_back(own.join(named, "response", "left_semi"), ["response"], *looked_up).unionByName(
        own.join(named, "response", "left_anti").select("*", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"),
                                                        F.col("page_id").alias("response_page")))
    problem = (F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("payload_bytes").isNull(), "no such response")
               .when(F.col("told") != F.col("payload_digest"), "another payload than the record's digest tells"))
    return joined.select("page_id", "type", "payload_bytes", "payload_digest", F.when(F.col("type") == "revisit", F.col("response_page")).alias(
        "refers_page"), problem.alias("problem"))
