"""WARC archives, index first.

Writing: pages go to gzip-per-record archives; every record's file, offset, length,
URL and payload digest form the index, written as a table beside them. Of pages with
equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is a
``response`` record and the others are ``revisit`` records that name it and hold no
payload. Reading starts from the index: select rows of it, and the byte ranges of
the selected records are read in file order, neighbours in one read.

Plan: payloads do not move. A narrow table (id, URL, digest, size) is written first;
digests aggregated before the shuffle say which of its rows are revisits, and these are
written as records from the narrow rows. Their ids set bits of a table of fixed size
(SLOTS bits). A page whose bits are not all set is a response and written where it is
read; the few responses that the bits misjudge are known from the narrow table and
fetched by a join, more of them when revisits outgrow the table. Each task writes its
rows as archives of its own
(begun anew at FILE_BYTES), under a name unique to the attempt, and returns their
index rows, so a retried task leaves no wrong entry. Readers are dealt ranges of
(file, offset).

Defined cases: null html is an empty payload; a null URL has no target line; a null
page_id is never the smallest and is read back as null; rows that share the smallest
page_id of their payload are all responses; control characters in URLs are
percent-encoded in the record and kept in the index; empty tables write nothing and
read back no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_file, put_stream, scratch, written

MIN_REVISIT = 100
FILE_BYTES = 256 << 20
GAP, READ_BYTES = 64 << 10, 8 << 20  # join reads over gaps of so much, up to so much
LEVEL = 3
SLOTS = 1 << 24                # bits of the table of revisits: two megabytes
DATE = "2024-01-01T00:00:00Z"  # the tables carry no fetch time
INDEX = ("page_id bigint, url string, digest string, record_type string, refers_to bigint, "
         "file string, offset bigint, length bigint")


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """page_id, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("Page-ID"), "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-ID"),
            "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest}


def _bits(keys: DataFrame) -> bytes:
    """The bit table of a column ``key``, two bits a key: SLOTS bits, whatever the number of rows."""
    one, two = F.col("key").bitwiseAND(F.lit(SLOTS - 1)), F.shiftright("key", 32).bitwiseAND(F.lit(SLOTS - 1))
    rows = (keys.select(F.explode(F.array(one, two)).alias("slot"))
            .groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
            .collect())  # SLOTS / 64 rows at most
    table = np.zeros(SLOTS // 64, np.int64)
    for row in rows:
        table[row["at"]] = row["bits"]
    return table.astype("<i8").tobytes()


def _set(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have both bits set."""
    out, last = np.ones(len(keys), bool), 8 * len(table) - 1
    for slot in (keys & last, (keys >> 32) & last):
        out &= (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return out


def _write(rows: DataFrame, folder: str, table=None) -> DataFrame:
    """Write rows (page_id, url, digest, refers_to, size, key, payload) as records; returns
    their index rows. Rows whose bits are set in ``table`` (broadcast) are left out."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        bits = None if table is None else np.frombuffer(table.value, np.uint8)
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(~_set(bits, batch.column("key").to_numpy())))
            index = []
            for i in range(batch.num_rows):
                page_id, url, digest, refers_to, size = (batch.column(c)[i].as_py() for c in range(5))
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = put_stream(folder, name)
                press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = press.compress(_record(page_id, url, batch.column("payload")[i].as_py(), size, digest, refers_to)) + press.flush()
                out.write(data)
                index.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to,
                              name, at, len(data)))
                at += len(data)
            if index:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*index, strict=True), (
                        pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()),
                        strict=True)],
                    ["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"])
        if out is not None:
            out.close()

    return rows.mapInArrow(write, INDEX)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages below ``folder``; returns the index (already written as a table)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    full = (pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
            .select("page_id", "url", "digest", F.lit(None).cast("bigint").alias("refers_to"),
                    F.octet_length("payload").cast("bigint").alias("size"), F.xxhash64("page_id", "digest").alias("key"), "payload"))
    narrow = written(full.drop("refers_to", "payload"), "warc-digests")
    repeated = (narrow.filter(F.col("size") >= MIN_REVISIT).groupBy("digest")
                .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    revisits = written(narrow.join(repeated, "digest").filter(other).select(
        "page_id", "url", "digest", F.col("first").alias("refers_to"), "size", "key", F.lit(None).cast("binary").alias("payload")),
        "warc-revisits")
    table = pages.sparkSession.sparkContext.broadcast(_bits(revisits))

    def misjudged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(_set(bits, batch.column("key").to_numpy())))

    same = lambda a, b: (a["digest"] == b["digest"]) & a["page_id"].eqNullSafe(b["page_id"])
    maybe = narrow.select("page_id", "digest", "key").mapInArrow(misjudged, "page_id bigint, digest string, key bigint")
    wrong = written(maybe.join(revisits, same(maybe, revisits), "left_anti").distinct(), "warc-misjudged")
    index = _write(full, folder, table).unionAll(_write(revisits, folder))
    if not wrong.isEmpty():
        index = index.unionAll(_write(full.join(wrong, same(full, wrong), "left_semi"), folder))
    return written(index, "warc-index")


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Neighbouring records (sorted by file and offset) that one read fetches."""
    run: list[dict] = []
    for r in rows:
        if run and (r["file"] != run[-1]["file"] or r["offset"] > run[-1]["offset"] + run[-1]["length"] + GAP
                    or r["offset"] + r["length"] > run[0]["offset"] + READ_BYTES):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the given index rows: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest and, if asked for, payload (null for a revisit).
    Response payloads are checked against their digests in any case."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _ranges(batch.to_pylist()):
                base = run[0]["offset"]
                with open_file(folder, run[0]["file"]) as f:
                    data = f.read_at(max(r["offset"] + r["length"] for r in run) - base, base)
                out = []
                for r in run:
                    raw = data[r["offset"] - base:r["offset"] - base + r["length"]]
                    out.append(parse_record(zlib.decompress(raw, 31)) | {"url": r["url"]})
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in kinds],
                                                 [c for c, _ in kinds])

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = (index.select("file", "offset", "length", "url").repartitionByRange(n, "file", "offset")
              .sortWithinPartitions("file", "offset"))
    return wanted.mapInArrow(read, "page_id bigint, url string, record_type string, refers_to bigint, "
                             "payload_bytes bigint, payload_digest string" + ", payload binary" * payloads)


def warc_digest(pages: DataFrame) -> DataFrame:
    """Write all pages to a new folder below the shared one and read them all back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
