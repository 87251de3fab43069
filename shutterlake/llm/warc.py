"""WARC archives: writing, normalising to one gzip member per record, reading.

Archives are files in a folder that all executors share; a task writes, rewrites
or reads one at a time as a stream, so it holds one record. Files appear under
their final names only when complete, and a task that runs again writes the
same file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from .shared import partitions, settled

LEVEL = 4
_CHUNK = 1 << 20


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file."""
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1."""
    digits = F.sha1(payload)
    eight = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c if c.isprintable() and c != " " else "%" + c.encode().hex().upper() for c in url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class Inflated:
    """Reads a gzip file of one or more members as one stream."""

    def __init__(self, source: BinaryIO):
        self.source, self.gz, self.have = source, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.gz.eof:
            rest = self.gz.unused_data or self.source.read(_CHUNK)
            if not rest:
                return False
            self.gz = zlib.decompressobj(31)
        else:
            rest = self.source.read(_CHUNK)
            if not rest:
                raise EOFError("a gzip member ends early")
        self.have += self.gz.decompress(rest)
        return True

    def line(self) -> bytes:
        start = 0
        while (end := self.have.find(b"\n", start)) < 0:
            start = len(self.have)
            if not self._more():
                return b""
        out = bytes(self.have[: end + 1])
        del self.have[: end + 1]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self._more():
                raise EOFError("a record ends early")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def records(stream: Inflated) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, block and whole bytes of each record."""
    while first := stream.line():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        raw, head = first, {}
        while (line := stream.line()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
            raw += line
        block = stream.exactly(int(head["content-length"]))
        yield head, block, raw + b"\r\n" + block + stream.exactly(4)


def _finished(folder: str, name: str, fill) -> str:
    """Writes ``name`` in ``folder`` by ``fill(file)`` and gives its URI."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
    with system.open_output_stream(draft) as out:
        fill(out)
    system.move(draft, f"{path}/{name}")
    return f"{folder}/{name}"


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pid, digest, same and refers_to (null for a response) for every distinct pair
    of page_id and payload: of equal payloads of at least ``least_bytes`` the
    largest page_id is the response. Payloads are equal if their SHA-256
    (``same``) and size are; the SHA-1 of the records, for which unequal payloads
    have been made, decides nothing. A group of copies collapses in each task,
    and html is not shuffled for it."""
    facts = pages.select("_pid", "page_id", "digest", "same", "size").distinct()
    last = facts.where(F.col("size") >= least_bytes).groupBy("same", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    target = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return facts.join(last, ["same", "size"], "left").select("_pid", "digest", "same", target.alias("refers_to"))


def compressed(rows: DataFrame) -> DataFrame:
    """``rows`` with each payload as a zstd frame: about a fifth less to shuffle than
    the shuffle's own compression leaves."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = pa.array((press.compress(x.as_buffer()) for x in batch.column("payload")), pa.binary())
            yield batch.set_column(batch.schema.get_field_index("payload"), "payload", bodies)

    return rows.mapInArrow(run, rows.schema)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC files, each one gzip stream,
    into ``folder`` and gives file and records of each.

    Null html is an empty payload. A page_id that repeats gives a record per
    row; null page_ids are responses unless equal to one with an id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pid = F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), pid.alias("_pid"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload"), "same": F.sha2("payload", 256)})
    decided = revisits(rows, least_bytes)
    # the join's own partitions become the files: html is shuffled once
    dealt = compressed(rows.drop("size")).join(decided.hint("shuffle_hash"), ["_pid", "digest", "same"]).sortWithinPartitions("_pid", "digest")

    def run(batches):
        from pyspark import TaskContext

        number, n = TaskContext.get().partitionId(), 0
        first = next(batches, None)
        if first is None or not first.num_rows:
            first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def fill(out):
            nonlocal n
            gz, frames = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), zstandard.ZstdDecompressor()

            def rest():
                yield first
                yield from batches

            for batch in rest():
                for row in zip(*(batch.column(c).to_pylist() if c != "payload" else batch.column(c) for c in ("page_id", "url", "digest", "payload", "refers_to"))):
                    out.write(gz.compress(record(row[0], row[1], row[2], frames.decompress(row[3].as_buffer()), row[4])))
                    n += 1
            out.write(gz.flush())

        name = _finished(folder, f"part-{number:06d}.warc.gz", fill)
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return settled(dealt.select("page_id", "url", "digest", "payload", "refers_to").mapInArrow(run, "file string, records long"))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each ``file`` (WARC in gzip members of any kind) into ``folder``
    with every record as its own member, next to a sidecar ``.idx`` of JSON lines
    (offset, length, id, type, digest), and gives the index: file, offset, length,
    record_id, record_type, payload_digest.

    A file is inflated once, as a stream. An empty table gives an empty index.
    """

    def run(batches):
        for batch in batches:
            for source in batch.column("file").to_pylist():
                index, at = [], 0

                def fill(out, source=source, index=index):
                    nonlocal at
                    system, path = place(source)
                    with system.open_input_stream(path, compression=None) as opened:
                        for head, _, raw in records(Inflated(opened)):
                            gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            member = gz.compress(raw) + gz.flush()
                            out.write(member)
                            index.append({"offset": at, "length": len(member), "id": head.get("warc-record-id"), "type": head.get("warc-type"), "digest": head.get("warc-payload-digest")})
                            at += len(member)

                name = source.rsplit("/", 1)[1]
                done = _finished(folder, name, fill)
                _finished(folder, f"{name}.idx", lambda out, index=index: out.write("".join(json.dumps(x) + "\n" for x in index).encode()))
                columns = [[x[k] for x in index] for k in ("offset", "length", "id", "type", "digest")]
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3]
                yield pa.record_batch([pa.array([done] * len(index), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["file", "offset", "length", "record_id", "record_type", "payload_digest"])

    dealt = files.select("file").repartition(max(1, partitions(files.sparkSession)), "file")
    return settled(dealt.mapInArrow(run, "file string, offset long, length long, record_id string, record_type string, payload_digest string"))


def read_archives(index: DataFrame) -> DataFrame:
    """Reads every record of ``index`` at its offset: page_id, url, record_type,
    refers_to, payload_bytes, payload_digest (of a response counted and computed
    from the payload read, of a revisit as its headers say), payload (null for a
    revisit). A response that does not match its digest raises an error."""
    pages = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def number(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches):
        opened, system_file = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if name != opened:
                    system, path = place(name)
                    opened, system_file = name, system.open_input_file(path)
                system_file.seek(offset)
                raw = zlib.decompress(system_file.read(length), 31)
                head, block = _parse(raw)
                top, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(x for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                refers = number(head.get("warc-refers-to"))
                if head["warc-type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != digest or size != len(payload):
                        raise ValueError(f"{head['warc-record-id']}: digest {digest}, payload {found}")
                else:
                    payload = None
                rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], refers, size, digest, payload))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return index.select("file", "offset", "length").mapInArrow(run, pages)


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = {}
    for line in top.split(b"\r\n")[1:]:
        name, _, value = line.decode().partition(":")
        head[name.strip().lower()] = value.strip()
    return head, rest[: int(head["content-length"])]
