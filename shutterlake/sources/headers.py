"""Headers of picture files: the tag directories at the start of TIFF and JPEG bytes.

A header is read from the bytes of a column, batch by batch; only what the
directories point to is looked at, every offset is held against the length, and
no directory is entered twice. What cannot be read is null, never an error.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S

# Tags, and bytes of one value of each type.
MAKE, MODEL, ORIENTATION, DETAILS, PLACE, TAKEN = 0x010F, 0x0110, 0x0112, 0x8769, 0x8825, 0x9003
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_ASCII, _SHORT, _LONG, _RATIONAL = 2, 3, 4, 5

_RAW = "camera_make string, camera_model string, orientation int, taken_text string, lat_ref string, lat array<double>, lon_ref string, lon array<double>"


def _tiff_start(data: bytes) -> int:
    """Where the directories' offsets count from: 0, behind the marker segment of
    a JPEG file that holds them, or -1."""
    if data[:2] != b"\xff\xd8":
        return 0 if data[:4] in (b"II*\0", b"MM\0*") else -1
    at = 2
    while data[at : at + 1] == b"\xff" and at + 4 <= len(data):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return at + 10
        if data[at + 1] == 0xDA or size < 2:  # pixels follow
            return -1
        at += 2 + size
    return -1


def _tags(data: bytes, order: str, at: int, seen: set[int]) -> dict[int, tuple[int, bytes]]:
    """tag -> (type, value bytes) of the directory at ``at``; the first of a repeated tag counts."""
    if at in seen or at < 8 or at + 2 > len(data):
        return {}
    seen.add(at)
    found: dict[int, tuple[int, bytes]] = {}
    for k in range(int.from_bytes(data[at : at + 2], order)):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind, count = (int.from_bytes(entry[a:b], order) for a, b in ((0, 2), (2, 4), (4, 8)))
        size = WIDTH.get(kind, 0) * count
        start = int.from_bytes(entry[8:12], order)
        value = entry[8 : 8 + size] if size <= 4 else data[start : start + size]
        if size and len(value) == size:
            found.setdefault(tag, (kind, value))
    return found


def _text(tag) -> str | None:
    return tag[1].split(b"\0")[0].decode("ascii", "replace") if tag and tag[0] == _ASCII else None


def _number(tag, order: str) -> int | None:
    return int.from_bytes(tag[1][: WIDTH[tag[0]]], order) if tag and tag[0] in (1, _SHORT, _LONG) else None


def _ratios(tag, order: str) -> list[float] | None:
    if not tag or tag[0] != _RATIONAL or len(tag[1]) < 24:
        return None
    whole = [int.from_bytes(tag[1][a : a + 4], order) for a in range(0, 24, 4)]
    return [n / d for n, d in zip(whole[::2], whole[1::2])] if all(whole[1::2]) else None


def read_header(data: bytes | None) -> tuple:
    """The fields of ``_RAW``; all null if there is no directory."""
    start = _tiff_start(data) if data else -1
    if start < 0 or data[start : start + 2] not in (b"II", b"MM"):
        return (None,) * 8
    body = data[start:]
    order = "little" if body[:2] == b"II" else "big"
    seen: set[int] = set()
    first = _tags(body, order, int.from_bytes(body[4:8], order), seen)
    inner = {t: _tags(body, order, _number(first.get(t), order) or 0, seen) for t in (DETAILS, PLACE)}
    place = inner[PLACE]
    return (
        _text(first.get(MAKE)), _text(first.get(MODEL)), _number(first.get(ORIENTATION), order), _text(inner[DETAILS].get(TAKEN) or first.get(TAKEN)),
        _text(place.get(LAT_REF)), _ratios(place.get(LAT), order), _text(place.get(LON_REF)), _ratios(place.get(LON), order),
    )


def write_header(order: str, tags: dict[int, object], details: dict[int, object], place: dict[int, object]) -> bytes:
    """A TIFF header with three directories. Values: text, a number (short), or
    a list of (numerator, denominator)."""
    sign = "<" if order == "little" else ">"

    def laid(items: dict[int, object], at: int) -> bytes:
        head, tail = struct.pack(sign + "H", len(items)), b""
        beyond = at + 2 + 12 * len(items) + 4
        for tag in sorted(items):
            v = items[tag]
            if isinstance(v, str):
                kind, count, value = _ASCII, len(v) + 1, v.encode("ascii") + b"\0"
            elif isinstance(v, list):
                kind, count, value = _RATIONAL, len(v), b"".join(struct.pack(sign + "II", *x) for x in v)
            else:
                kind, count, value = (_LONG, 1, struct.pack(sign + "I", v)) if tag in (DETAILS, PLACE) else (_SHORT, 1, struct.pack(sign + "H", v))
            if len(value) <= 4:
                cell = value.ljust(4, b"\0")
            else:
                cell, tail = struct.pack(sign + "I", beyond + len(tail)), tail + value + b"\0" * (len(value) % 2)
            head += struct.pack(sign + "HHI", tag, kind, count) + cell
        return head + b"\0" * 4 + tail

    sub = {DETAILS: details, PLACE: place}
    sizes = {t: len(laid(items, 0)) for t, items in sub.items() if items}
    whole = tags | {t: 0 for t in sizes}
    at = 8 + len(laid(whole, 8))
    for t in sizes:
        whole[t], at = at, at + sizes[t]
    return (b"II*\0" if order == "little" else b"MM\0*") + struct.pack(sign + "I", 8) + laid(whole, 8) + b"".join(laid(sub[t], whole[t]) for t in sizes)


def in_jpeg(header: bytes) -> bytes:
    """The start of a JPEG file with ``header`` behind another segment."""
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xe1" + struct.pack(">H", 8 + len(header)) + b"Exif\0\0" + header + b"\xff\xda\0\0"


def with_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without ``content`` (bytes), with camera_make, camera_model,
    orientation, date_taken, latitude and longitude from its header.

    Bytes without a header, cut-off or looping directories and nulls give nulls
    for what they do not hold; like-named columns are replaced.
    """
    own = ["camera_make", "camera_model", "orientation", "date_taken", "latitude", "longitude"]
    raw = [c.split()[0] for c in _RAW.split(", ")]
    rest = [c for c in files.columns if c not in [*own, *raw, content]]
    kinds = [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.list_(pa.float64())]

    def run(batches):
        for batch in batches:
            fields = zip(*map(read_header, batch.column(content).to_pylist())) if batch.num_rows else [[]] * len(raw)
            yield pa.record_batch([*(batch.column(c) for c in rest), *(pa.array(list(f), t) for f, t in zip(fields, types))], [*rest, *raw])

    found = files.select(*rest, content).mapInArrow(run, ", ".join([*kinds, _RAW]))
    degrees = lambda c: S.dms_degrees(F.col(c)[0], F.col(c)[1], F.col(c)[2], F.col(f"{c}_ref"))
    return found.withColumns({"date_taken": S.exif_time(F.col("taken_text")), "latitude": degrees("lat"), "longitude": degrees("lon")}).select(*rest, *own)
