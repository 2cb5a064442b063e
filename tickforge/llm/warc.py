"""WARC archives: writing with revisits, segments and chunked framing, and reading back with segment reassembly.

Writing: pages with equal payloads of at least `min_bytes` become one response (the smallest page_id) and
revisits of it; which they are is settled on digests alone. A payload is framed by chunked transfer encoding; a
record block longer than `segment_bytes` is cut into a first segment and continuation records. As records end in
two line ends and payloads are UTF-8, Spark's text writer with that separator makes valid gzipped WARC files,
of bounded size, in any store that Spark writes.

Reading: each task parses its files by Content-Length. Records that are whole are decoded at once; only segments
are shuffled: grouped by origin record, ordered by number, verified (numbers gapless from 1, total length), joined
and decoded. A payload that doesn't match its digest raises ValueError, and so does a revisit of a page that has no response
with its digest. A record is named by its page_id and its payload's digest, so rows that share a page_id keep apart.

Nulls and edge cases: null html is an empty payload; rows without page_id are left out; repeated rows of a page_id,
equal or not, are written and read back each, and those with the smallest page_id of a payload are all responses; extra columns are left out; null urls are written as empty; an empty table makes an
archive without records; pages far longer than a segment only make more segments.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy, join_spread, new_path, save

END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 16_384, 4_096, 2_000
DATE = b"2024-01-01T00:00:00Z"
PARSED = "record string, page_id long, type string, url string, refers_to long, digest string, number int, total long, block binary"


def cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most `size` bytes that end between characters."""
    i = 0
    while i < len(data):
        j = min(i + size, len(data))
        while j < len(data) and data[j] & 0xC0 == 0x80:
            j -= 1
        yield data[i:j]
        i = j


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Undoes chunked framing, chunk extensions and trailers included."""
    out, i = [], 0
    while True:
        j = body.index(b"\r\n", i)
        n = int(body[i:j].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[j + 2 + n : j + 4 + n] != b"\r\n":
            raise ValueError("a chunk isn't as long as its header says")
        out.append(body[j + 2 : j + 2 + n])
        i = j + 4 + n


def record(kind: bytes, name: bytes, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<" + name + b">"), (b"WARC-Date", DATE), *headers, (b"Content-Length", b"%d" % len(block))]
    return b"WARC/1.1\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in head) + b"\r\n" + block


def page_records(page_id: int, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    digest = hashlib.sha256(payload).hexdigest().encode()
    name = b"urn:x-page:%d:%s" % (page_id, digest[:32])
    uri = (url or "").replace("\r", "").replace("\n", "").encode()
    about = [(b"WARC-Target-URI", uri), (b"WARC-Payload-Digest", b"sha256:" + digest)]
    if refers_to is not None:
        profile = (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [record(b"revisit", name, [*about, profile, (b"WARC-Refers-To", b"<urn:x-page:%d:%s>" % (refers_to, digest[:32]))], b"")]
    block = HTTP + chunked(payload)
    about.append((b"Content-Type", b"application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        return [record(b"response", name, about, block)]
    parts = list(cuts(block, segment_bytes))
    out = [record(b"response", name, [*about, (b"WARC-Segment-Number", b"1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        own = [(b"WARC-Segment-Origin-ID", b"<" + name + b">"), (b"WARC-Segment-Number", b"%d" % k)]
        if k == len(parts):
            own.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(record(b"continuation", name + b":%d" % k, own, part))
    return out


def write(pages: DataFrame, path: str, min_bytes: int = 100, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes a record, or its segments, for each row of pages (page_id, url, html)."""
    pages = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha2("html", 256)))
    prints = save(pages.select("page_id", digest.alias("d")).where("d is not null"), "prints")
    firsts = save(prints.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("n")).where("refers_to < last"), "firsts")
    revisits = join_spread(prints, firsts.select("d", "refers_to"), "d", heavy(firsts, "d"), ["page_id"]).where("page_id > refers_to").select("page_id", "d", "refers_to").distinct()

    def build(batches):
        for b in batches:
            out = [r for p, u, h, to in zip(*(c.to_pylist() for c in b.columns)) for r in page_records(p, u, h.encode(), to, segment_bytes)]
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 1000], pa.binary()).cast(pa.string())], names=["value"])

    rows = pages.withColumn("d", digest).join(revisits, ["page_id", "d"], "left").select("page_id", "url", "html", "refers_to").mapInArrow(build, "value string")
    rows.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    i = 0
    while i < len(data):
        j = data.index(END, i)
        lines = data[i:j].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {i}")
        headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(headers["content-length"])
        yield headers, data[j + 4 : j + 4 + n]
        i = j + 4 + n + len(END)
        if data[i - 4 : i] != END:
            raise ValueError(f"the record before byte {i} isn't as long as its header says")


def inflate(data: bytes) -> bytes:
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def page_of(uri: str | None) -> int | None:
    return int(uri.strip("<>").split(":")[2]) if uri else None


def payload_of(block: bytes, digest: str) -> bytes:
    """The payload of a whole response block, checked against its digest."""
    head, body = block.split(END, 1)
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if "sha256:" + hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't match its digest")
    return payload


def reassemble(segments: list[dict]) -> list[tuple[bytes, dict]]:
    """(block, first segment) for a record's segments; more than one if equal records are repeated."""
    times, firsts = Counter(s["number"] for s in segments), [s for s in segments if s["number"] == 1]
    by = {s["number"]: s for s in segments}
    total = by[max(by)]["total"]
    block = b"".join(by[k]["block"] for k in sorted(by))
    if sorted(by) != list(range(1, len(by) + 1)) or total != len(block) or len(set(times.values())) > 1:
        raise ValueError("segments are missing or don't add up to the total length")
    return [(block, first) for first in firsts]


RECORDS = "page_id long, type string, url string, refers_to long, digest string, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, type, url, refers_to, digest, payload): one row a record; revisits have no payload of their own."""

    def parse_files(batches):
        names = [c.split()[0] for c in PARSED.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse(inflate(content.as_py())):
                    origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                    number, kind, total = h.get("warc-segment-number"), h["warc-type"], h.get("warc-segment-total-length")
                    if kind == "response" and not number:
                        block = payload_of(block, h["warc-payload-digest"])
                    rows.append((origin, page_of(origin), kind, h.get("warc-target-uri"), page_of(h.get("warc-refers-to")), h.get("warc-payload-digest"), number and int(number), total and int(total), block))
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 500]), kinds)], names=names)

    def join_segments(batches):
        for b in batches:
            rows = []
            for segments in b.column(0).to_pylist():
                for block, first in reassemble(segments):
                    rows.append((first["page_id"], first["type"], first["url"], None, first["digest"], payload_of(block, first["digest"])))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()])], names=[c.split()[0] for c in RECORDS.split(", ")])

    parsed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(parse_files, PARSED)
    whole = parsed.where("number is null").select("page_id", "type", "url", "refers_to", "digest", F.when(F.col("type") == "response", F.col("block")).alias("payload"))
    # A group is one record's segments.
    grouped = parsed.where("number is not null").groupBy("record").agg(F.collect_list(F.struct("page_id", "type", "url", "digest", "number", "total", "block")).alias("segments"))
    return whole.unionByName(grouped.select("segments").mapInArrow(join_segments, RECORDS))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read_back = save(read(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", F.substring_index("digest", ":", -1).alias("told")), "records")
    responses = read_back.where("record_type = 'response'").drop("told")
    full = responses.select(F.concat_ws(":", "page_id", "payload_digest").alias("of"), "payload_bytes", "payload_digest").dropDuplicates(["of"]).withColumn("found", F.lit(True))
    revisits = read_back.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.concat_ws(":", "refers_to", "told").alias("of"))
    asked = revisits.groupBy("of").agg(F.count("*").alias("n"))
    # A revisit whose response isn't there must not go missing: it joins a row of its own, which raises.
    lost = asked.join(full, "of", "left_anti").select("of", F.lit(None).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("payload_digest"), F.lit(False).alias("found"))
    joined = join_spread(revisits, full.unionByName(lost), "of", heavy(asked, "of"), ["page_id"])
    checked = F.when(F.col("found"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit has no response with its digest")))
    return responses.unionByName(joined.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
