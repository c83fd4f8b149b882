"""WARC archives read by index.

Each task writes one archive (records are gzip members of their own) into the shared folder under a name of its own and returns
the index of what it wrote: file, offset, length, URL, digest. A lost task's file is never in the index. Readers sort the index
by place, join ranges that are close, and read and parse only those bytes.

Of records with one payload, that with the largest page_id is the response and the others are revisits of it; payloads below
`least` bytes are all responses. Null html is an empty payload, a null URL an empty one. Rows that repeat page_id and payload
are responses alike if the id is the largest; rows with a null id are revisits where their payload has an id, else responses.
Other columns are not read. An empty table gives no archives and an empty result. A very long page is one record, held whole by
the task that writes or reads it. Record ids are unique: a response is named by its page and payload, all others by their file and
number too.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DATE = "2024-01-01T00:00:00Z"
#: Ranges up to this far apart are read in one go, and at most that much.
GAP, MOST = 64 << 10, 8 << 20
#: Archive bytes of a reading task.
SHARE = 16 << 20
_INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page: int | None, name: str, own: str = "") -> str:
    return f"<urn:shelfmark:page:{'' if page is None else page}:{name}{own and ':'}{own}>"


def record(page: int | None, url: str | None, payload: bytes, name: str, refers: int | None, own: str = "") -> bytes:
    """One gzip member. A revisit (refers given) holds the HTTP header alone. `own` tells records of one page and payload apart."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    url = "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_uri(page, name, own)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{name}", "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers, name)}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record's bytes."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes archives under folder and returns their index."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_sha", F.sha1("html"))
    pairs = pages.groupBy("_sha", "page_id").agg(F.count("*").alias("cnt"), F.min(F.coalesce("url", F.lit(""))).alias("_low"))
    pairs = common.spool(pairs)
    best = common.spool(pairs.groupBy("_sha").agg(F.max("page_id").alias("_first"), F.sum("cnt").alias("n")))
    total = best.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = common.lookup(pages, best, ["_sha"], total).select("page_id", "url", "html", "_first", "_sha")
    if pairs.filter("cnt > 1 AND page_id IS NOT NULL").limit(1).count():
        # rows that repeat a page and its payload are one row with their number, so that just one of them gets the plain name
        one = joined.groupBy("page_id", "_sha", "url").agg(F.first("html").alias("html"), F.first("_first").alias("_first"), F.count("*").alias("copies"))
        p = pairs.select(F.col("page_id").alias("_p"), F.col("_sha").alias("_s"), "_low")
        joined = one.join(p, (F.col("_sha") == F.col("_s")) & F.col("page_id").eqNullSafe(F.col("_p"))).select("page_id", "url", "html", "_first", "copies", (F.coalesce("url", F.lit("")) == F.col("_low")).alias("named"))
    else:
        joined = joined.select("page_id", "url", "html", "_first", F.lit(1).cast("long").alias("copies"), F.lit(True).alias("named"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        own = uuid.uuid4().hex
        name, out, at, index = f"{root}/{own}.warc.gz", None, 0, []
        for b in batches:
            for page, url, html, first, copies, named in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                refers = first if len(payload) >= least and first is not None and first != page else None
                name_of = digest(payload)
                for k in range(copies):
                    alone = refers is None and page is not None and page == first and named and k == 0  # revisits refer to it
                    data = record(page, url, payload, name_of, refers, "" if alone else f"{own}-{len(index)}")
                    if out is None:
                        where.create_dir(root, recursive=True)
                        out = where.open_output_stream(name, compression=None)  # members are compressed one by one
                    out.write(data)
                    index.append((name, at, len(data), url, name_of, page, "response" if refers is None else "revisit", refers))
                    at += len(data)
        if out is not None:
            out.close()
        cols = list(zip(*index, strict=True)) if index else [()] * 8
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])

    return common.spool(joined.mapInArrow(common.frugal(run), _INDEX))


def read(index: DataFrame, folder: str) -> DataFrame:
    """file, offset, page_id, url, record_type, refers_to, payload_digest and payload (null for a revisit) of the records in index,
    all from the archives' bytes."""
    placed = index.select("file", "offset", "length")
    tasks = max(1, -(-(placed.agg(F.sum("length")).first()[0] or 0) // SHARE))
    placed = placed.repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(folder)
        number = lambda uri: int(n) if (n := uri.strip("<>").split(":")[3]) else None

        def ranges() -> Iterator[tuple[str, list[tuple[int, int]]]]:
            now, held = None, []
            for b in batches:
                for file, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and (file != now or at - sum(held[-1]) > GAP or at + n - held[0][0] > MOST):
                        yield now, held
                        held = []
                    now = file
                    held.append((at, n))
            if held:
                yield now, held

        name = file = None
        for f, held in ranges():
            if f != name:
                if file is not None:
                    file.close()
                file, name = where.open_input_file(f), f
            begin = held[0][0]
            data = file.read_at(sum(held[-1]) - begin, begin)
            rows = []
            for at, n in held:
                fields, payload = parse(data[at - begin : at - begin + n])
                is_response = fields["WARC-Type"] == "response"
                named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if is_response and digest(payload) != named:
                    raise ValueError(f"{f} at {at}: the payload does not have its digest")
                rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], None if is_response else number(fields["WARC-Refers-To"]), named, payload if is_response else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
        if file is not None:
            file.close()

    return placed.mapInArrow(common.frugal(run), schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages, reads the archives back, deletes them: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = f"{common.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    got = common.spool(read(write(pages, folder, least), folder).select("page_id", F.octet_length("payload").cast("long").alias("n"), "payload_digest", "record_type", "refers_to"))
    common.delete(pages.sparkSession, folder)
    # a revisit's payload is the response's that it refers to
    known = got.filter("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("n").alias("_n"))
    revisits = got.filter("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    bytes_of = common.spool(known.join(revisits, ["refers_to", "payload_digest"]))
    out = common.lookup(got.filter("record_type = 'revisit'").drop("n"), bytes_of, ["refers_to", "payload_digest"], got.count())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return got.filter("record_type = 'response'").withColumnRenamed("n", "payload_bytes").select(*columns).union(out.withColumnRenamed("_n", "payload_bytes").select(*columns))


SQL_BASE32 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT h, max(page_id) AS first FROM p GROUP BY h),
d AS (SELECT p.page_id, w.first, octet_length(encode(p.h)) AS n, sha1(p.h) AS x FROM p JOIN w USING (h)),
b AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(x, g * 5 + 1, 5))::BIGINT >> (15 - k * 5)) & 31) AS INTEGER) + 1, 1)), '')), '') AS s FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM b
"""
