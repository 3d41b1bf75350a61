"""WARC archives: a distributed writer of per-record gzip members and a splittable reader.

Files go through pyarrow's file systems (file, s3, gs, hdfs, ...), so any folder that all executors share will do. The
writer gives each task attempt a file of its own name and returns a manifest, so files of lost attempts are never read.
The reader deals byte ranges: a task looks for the gzip magic in its range, takes a candidate for a member only if
it inflates to a WARC header, owns the records that start inside its range and reads past its end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
_UNSAFE = re.compile(r"[^\x21-\x7e]")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def safe_uri(url: str | None) -> str:
    """Percent-encodes what may not stand in a header line."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url or "")


def build(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response, or a revisit of page ``refers_to`` without payload."""
    sha = hashlib.sha1(payload)
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha.hexdigest())}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {safe_uri(url)}"] * (url is not None) + [f"X-Page-Id: {page_id}"] * (page_id is not None)
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha.hexdigest())}", f"X-Refers-To-Page-Id: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """A record's fields; the digest of a response is computed from its payload and must agree with the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
    block = rest[: int(h["Content-Length"])]
    number = lambda k: int(h[k]) if k in h else None
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    out = {"record_type": h["WARC-Type"], "record_id": h["WARC-Record-ID"], "page_id": number("X-Page-Id"), "url": h.get("WARC-Target-URI"), "refers_to": number("X-Refers-To-Page-Id"), "payload_digest": digest}
    payload = block.partition(b"\r\n\r\n")[2]
    if out["record_type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {out['record_id']} doesn't have the digest of its header")
        return out | {"payload": payload, "payload_bytes": len(payload)}
    return out | {"payload": None, "payload_bytes": number("X-Payload-Length")}


def members(read, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of the WARC members that start in [start, end). read(offset, length) gives bytes.

    Bytes that look like a member and don't inflate to a WARC header are passed over; a member that begins with one and is
    damaged or cut short raises ValueError."""
    at = start
    buffer, base = b"", start  # buffer holds the bytes from base on
    while at < end:
        while (i := buffer.find(MAGIC, max(0, at - base))) < 0:
            tail = min(len(buffer), len(MAGIC) - 1)
            base, buffer = base + len(buffer) - tail, buffer[len(buffer) - tail :]
            at = max(at, base)
            if base >= end or not (more := read(base + len(buffer), CHUNK)):
                return
            buffer += more
        at = base + i
        if at >= end:
            return
        buffer, base = buffer[i:], at
        z, out, pos, good = zlib.decompressobj(31), [], 0, False
        try:
            while not z.eof:
                if pos == len(buffer):
                    more = read(base + pos, CHUNK)
                    if not more:
                        break
                    buffer += more
                # little at first, so that a damaged member is known by its header
                part = buffer[pos : pos + (CHUNK if good else 512)]
                out.append(z.decompress(part))
                pos += len(part)
                if not good and (got := sum(map(len, out))) >= 7:
                    good = b"".join(out)[:7] == b"WARC/1."
                    if not good:
                        break
                    del got
            good = good and z.eof
        except zlib.error:
            if good:
                raise ValueError(f"the record at byte {at} is damaged") from None
        if not good and b"".join(out)[:7] == b"WARC/1.":
            raise ValueError(f"the record at byte {at} is cut short")
        if good:
            used = pos - len(z.unused_data)
            yield at, b"".join(out)
            buffer, base = buffer[used:], base + used
            at = base
        else:
            at += 1


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of rows (page_id, url, html, refers_to); gives the manifest (file, bytes, records), written and read again.

    A null html is an empty payload; a null page_id or url leaves its header out.
    """

    def run(it):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        records = size = 0
        out = None
        for batch in it:
            for page_id, url, html, refers in zip(*(common.column(batch, c) for c in ("page_id", "url", "html", "refers_to"))):
                data = build(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers)
                out = out or fs.open_output_stream(name, compression=None)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out:
            out.close()
            yield {"file": [name], "bytes": [size], "records": [records]}

    return common.materialize(common.arrow(pages.select("page_id", "url", "html", "refers_to"), run, "file string, bytes long, records long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame, folder: str, split: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest lists; each once, whatever the split."""
    ranges = manifest.select("file", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split}L)")).alias("start"))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    schema = "file string, offset long, record_type string, record_id string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def run(it):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in it:
            for file, size, start in zip(*(common.column(batch, c) for c in ("file", "bytes", "start"))):
                with fs.open_input_file(file) as f:
                    rows, held = [], 0
                    for offset, data in members(lambda o, k: f.read_at(min(k, max(0, size - o)), o), size, start, min(size, start + split)):
                        rows.append({"file": file, "offset": offset} | parse(data))
                        held += len(data) if payloads else 0
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield {c: [r[c] for r in rows] for c in names}
                            rows, held = [], 0
                    if rows:
                        yield {c: [r[c] for r in rows] for c in names}

    return common.arrow(ranges.repartition(int(max(1, min(n, 10_000))), "file", "start"), run, schema)


def incomplete(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(file, records, found) of the archives of which not as many records were read as were written."""
    found = records.groupBy("file").agg(F.count("*").alias("found"))
    return manifest.join(found, "file", "left").select("file", "records", F.coalesce("found", F.lit(0).cast("long")).alias("found")).filter("records <> found")


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Adds refers_to: of rows with equal payloads of at least ``least`` bytes, all but those of the largest page_id
    revisit it. Rows that repeat that page_id are responses too; rows with a null page_id revisit the largest that is
    there, or are responses if all are null."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null")
    joined = rows.join(common.materialize(groups.select("digest", "top"), "revisits"), "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def round_trip(pages: DataFrame, split: int = 8 << 20) -> DataFrame:
    """Writes an archive of all pages and reads it back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Raises where an archive doesn't give back as many records as were written to it."""
    spark = pages.sparkSession
    folder = common.new_folder(spark, "warc")
    manifest = write(with_revisits(pages), folder)
    records = common.materialize(read(spark, manifest, folder, split, payloads=False), "records")
    if (bad := incomplete(manifest, records).first()) is not None:
        raise ValueError(f"{bad['file']}: {bad['found']} of {bad['records']} records were read")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
