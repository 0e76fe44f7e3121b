"""WARC archives of pages, and a reader that salvages damaged ones.

Writing: one record per row, each its own gzip member (or plain), with the
payload inside an HTTP response block.  Of rows with equal payloads of at least
``least`` bytes the one with the smallest page_id is written as ``response``;
the others are ``revisit`` records that name it and carry no payload, only its
length and digest.  Equal payloads are found by (SHA-1, length), counted before
the shuffle, so thousands of copies are one entry.

Reading: a gzip member must inflate and pass its own CRC, and a record in it
must have a version line, a length that fits, the closing blank lines and the
digest that its header states for the block.  After a failed check the reader
looks for the next member (or, in a plain file, version line) that passes all
of them, goes on from there, and logs the bytes in between as a gap.  In a member
of several records that inflates, the search goes by version lines of its inflated
bytes; such a gap names the member, and the bytes within it.

Results for odd input: a null html is the empty payload; a null page_id comes
after all others and is written as such; of rows equal in page_id and payload
one is the response, the others revisit it; a null url leaves its header out,
line ends in a url are percent-encoded; an empty table writes no archive and
gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_folder, table, written
from .token_files import put_file

#: compressed bytes after which a new archive is begun
ROLL = 16_000_000
MIN_PAYLOAD = 0
_MAGIC, _VERSION, _END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
_LEVEL = 6


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, '|'.join(map(str, key)))}>"


def record_bytes(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record, uncompressed."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {_urn(page_id, digest, 'revisit' if revisit else 'response')}",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_urn(refers_to, digest, 'response')}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
        head.append(f"X-Payload-Length: {len(payload)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def parse_record(data, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers (lower-case names), block and end of the record at ``at``;
    ValueError if any check fails."""
    if bytes(data[at:at + len(_VERSION)]) != _VERSION:
        raise ValueError("no version line")
    split = data.find(_END, at)
    if split < 0:
        raise ValueError("header without end")
    head = {}
    for line in bytes(data[at:split]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("broken header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
        raise ValueError("no content length")
    start, n = split + 4, int(head["content-length"])
    block = bytes(data[start:start + n])
    if len(block) < n or bytes(data[start + n:start + n + 4]) != _END:
        raise ValueError("record cut short")
    if "warc-block-digest" in head and head["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise ValueError("block digest differs")
    return head, block, start + n + 4


def _member(data, at: int) -> tuple[list[tuple[str, object]], int]:
    """Records, gaps and end of the gzip member at ``at``; ValueError if it has
    no sound record.  Fed in parts, so that a small member does not copy what follows."""
    inflate, body, k, step = zlib.decompressobj(31), [], at, 1 << 16
    view = memoryview(data)
    try:
        while not inflate.eof and k < len(data):
            body.append(inflate.decompress(view[k:k + step]))
            k += step
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not inflate.eof:
        raise ValueError("gzip member cut short")
    end = min(k, len(data)) - len(inflate.unused_data)
    found = list(_salvaged(b"".join(body), [_VERSION]))
    if not any(kind == "record" for kind, _ in found):
        raise ValueError(found[0][1][2] if found else "no version line")
    return [(kind, (at, end, f"{x[2]}, bytes {x[0]} to {x[1]} of the inflated member") if kind == "gap" else x) for kind, x in found], end


def salvage(data: bytes) -> Iterator[tuple[str, object]]:
    """("record", (headers, block)) for every sound record of a file's bytes
    in order, and ("gap", (start, end, reason)) for every run of bytes lost."""
    # a damaged beginning does not tell which kind of file it is
    yield from _salvaged(data, [m for m in (_MAGIC, _VERSION) if data.startswith(m)] or [_MAGIC, _VERSION])


def _salvaged(data: bytes, marks: list[bytes]) -> Iterator[tuple[str, object]]:
    """What :func:`salvage` gives, with the marks at which members or records may begin."""
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(_MAGIC, at) and _MAGIC in marks:
                found, end = _member(data, at)
            else:
                head, block, end = parse_record(data, at)
                found = [("record", (head, block))]
        except ValueError as e:
            if lost is None:
                lost, why = at, str(e)
            nexts = [k for k in (data.find(m, at + 1) for m in marks) if k >= 0]
            if not nexts:
                break
            at = min(nexts)
            continue
        if lost is not None:
            yield "gap", (lost, at, why)
            lost = None
        yield from found
        at = end
    if lost is not None:
        yield "gap", (lost, len(data), why)


_DONE = pa.schema([("file", pa.string()), ("records", pa.int64())])


def write_archives(pages: DataFrame, folder: str, least: int = MIN_PAYLOAD) -> DataFrame:
    """Write the archives; returns the names of those that count (a task given
    up may leave others) with their number of records."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    d = d.withColumns({"sha": F.sha1(F.encode("html", "utf-8")), "len": F.octet_length("html")})
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    per = d.groupBy("sha", "len").agg(F.min(key).alias("win"), F.count("*").alias("n"))
    same = d.groupBy("sha", "len", "page_id").agg(F.count("*").alias("same")).filter("same > 1")
    per = written(per.filter("n > 1").filter(F.col("len") >= least)
                  .select(F.col("sha").alias("s2"), F.col("len").alias("l2"), F.col("win.page_id").alias("win_id")), "payloads")
    twice = written(same.select(F.col("sha").alias("s3"), F.col("len").alias("l3"), F.col("page_id").alias("p3"), "same"), "repeated-rows")
    j = d.join(per, (F.col("sha") == F.col("s2")) & (F.col("len") == F.col("l2")), "left")
    is_copy = F.col("s2").isNotNull()
    wins = F.col("page_id").eqNullSafe(F.col("win_id"))
    j = j.withColumn("revisit", is_copy & ~wins)
    # rows equal in page_id and payload: only among winners does it matter which is the response
    repeats = not twice.isEmpty()
    if repeats:
        hit = (F.col("sha") == F.col("s3")) & (F.col("len") == F.col("l3")) & F.col("page_id").eqNullSafe(F.col("p3"))
        j = j.join(twice, hit & is_copy & wins, "left")
        lone = j.filter(F.col("same").isNull()).select("page_id", "url", "html", "revisit", "win_id")
        # one row per url and repetition; the first one of the smallest url is the response
        urls = j.filter(F.col("same").isNotNull()).groupBy("sha", "len", "page_id", "url").agg(F.first("html").alias("html"), F.first("win_id").alias("win_id"), F.count("*").alias("n"))
        lead = F.row_number().over(Window.partitionBy("sha", "len", "page_id").orderBy(F.asc_nulls_last("url"))) == 1
        many = (urls.withColumn("lead", lead).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
                .select("page_id", "url", "html", (~F.col("lead") | (F.col("k") > 1)).alias("revisit"), "win_id"))
        j = lone.unionByName(many)
    out = j.select("page_id", "url", "html", "revisit", F.when(F.col("revisit"), F.col("win_id")).alias("refers_to"))

    def write(batches):
        parts, size, n = [], 0, 0

        def flush():
            name = f"pages-{uuid.uuid4().hex}.warc.gz"
            put_file(folder, name, b"".join(parts))
            return table(_DONE, file=[name], records=[n])

        for b in batches:
            ids, urls, htmls, revisits, refers = b.columns
            for page, url, html, revisit, ref in zip(ids.to_pylist(), urls.to_pylist(), htmls, revisits.to_pylist(), refers.to_pylist()):
                member = gzip.compress(record_bytes(page, url, html.as_py().encode(), ref, revisit), _LEVEL, mtime=0)
                parts.append(member)
                size, n = size + len(member), n + 1
                if size >= ROLL:
                    yield flush()
                    parts, size, n = [], 0, 0
        if parts:
            yield flush()

    return written(out.mapInArrow(write, "file string, records long"), "archives")


_READ = pa.schema([("file", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("reason", pa.string())])
READ_SCHEMA = "file string, kind string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_start long, gap_end long, reason string"


def describe(head: dict, block: bytes) -> dict:
    """The fields of a record; those of a response come from its payload."""
    number = lambda name: int(head[name]) if re.fullmatch(r"-?[0-9]{1,19}", head.get(name, "")) else None
    out = {"page_id": number("x-page-id"), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"), "refers_to": None}
    if out["record_type"] == "revisit":
        digest = head.get("warc-payload-digest", "")
        return out | {"payload_bytes": number("x-payload-length"), "payload_digest": digest.removeprefix("sha1:"), "refers_to": number("x-refers-to-page-id")}
    payload = block[block.find(_END) + 4:]
    return out | {"payload_bytes": len(payload), "payload_digest": sha1_base32(payload)}


def read_archives(spark: SparkSession, folder: str, catalogue: DataFrame | None = None) -> DataFrame:
    """Every sound record (kind ``record``) and every gap (kind ``gap``) of the
    archives in a folder; only those in ``catalogue`` if that is given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if catalogue is not None:
        files = files.join(catalogue.select("file"), "file")

    def read(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows: list[dict] = []
                for kind, what in salvage(data.as_py()):
                    if kind == "record":
                        rows.append({"file": name, "kind": kind} | describe(*what))
                    else:
                        rows.append({"file": name, "kind": kind, "gap_start": what[0], "gap_end": what[1], "reason": what[2]})
                    if len(rows) >= 5000:
                        yield table(_READ, **{c: [r.get(c) for r in rows] for c in _READ.names})
                        rows = []
                if rows:
                    yield table(_READ, **{c: [r.get(c) for r in rows] for c in _READ.names})

    return files.select("file", "content").mapInArrow(read, READ_SCHEMA)


def warc_round_trip(pages: DataFrame, least: int = MIN_PAYLOAD) -> DataFrame:
    """Write the archives of ``pages`` into the shared folder and read them back."""
    spark = pages.sparkSession
    if pages.isEmpty():
        return spark.createDataFrame([], READ_SCHEMA)
    folder = shared_folder(spark, "archives")
    return read_archives(spark, folder, write_archives(pages, folder, least))
