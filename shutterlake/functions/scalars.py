"""Column expressions used by the operators. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0

#: Fixed value: the 32 digits of a geohash.
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"

#: Extensions of video files.
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp")


def effective_date(taken: str = "date_taken", modified: str = "modified_utc") -> Column:
    """When a photo counts as taken: its own date, else the file's."""
    return F.coalesce(F.col(taken), F.col(modified))


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def is_video(extension: str | Column) -> Column:
    return F.lower(extension).isin(*VIDEO_EXTENSIONS)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geohash(lat: Column, lon: Column, precision: int = 5) -> Column:
    """Geohash; a point on a cell's edge belongs to the lower cell. Null where a coordinate is."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2

    def cell(value: Column, span: float, n: int) -> Column:
        place = F.ceil((value + span / 2) / span * 2**n) - 1
        return F.greatest(F.lit(0), F.least(F.lit(2**n - 1), place)).cast("long")

    x, y = cell(lon, 360.0, n_lon), cell(lat, 180.0, n_lat)
    # Bits alternate from the highest on, longitude first.
    bit = [F.shiftright(x, n_lon - 1 - i // 2) if i % 2 == 0 else F.shiftright(y, n_lat - 1 - i // 2) for i in range(bits)]
    digits = [reduce(lambda a, b: a * 2 + b, [b.bitwiseAND(F.lit(1)) for b in bit[k : k + 5]]) for k in range(0, bits, 5)]
    table = F.array(*[F.lit(c) for c in GEOHASH_DIGITS])
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*[F.element_at(table, (d + 1).cast("int")) for d in digits]))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mean_hash(values: str) -> Column:
    """Bit i of the result is set iff value i is above the mean; up to 64 values."""
    mean = f"aggregate({values}, 0D, (s, v) -> s + v, s -> s / size({values}))"  # once, not for every bit
    bits = f"aggregate(sequence(0, size({values}) - 1), 0L, (h, i) -> h | if(element_at({values}, i + 1) > m, shiftleft(1L, i), 0L))"
    return F.expr(f"transform(array({mean}), m -> {bits})[0]")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or vectors of different lengths."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def l2_normalised(v: Column) -> Column:
    """The unit vector; vectors of (almost) no length stay as they are."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm < 1e-6, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def pixel_normalised(v: Column, centre: float = 127.5, scale: float = 128.0) -> Column:
    return F.transform(v, lambda x: (x.cast("double") - centre) / scale)


def filled_parts(name: Column) -> Column:
    """The non-empty parts of a name between commas."""
    return F.filter(F.split(name, ","), lambda x: F.length(x) > 0)


def country(name: Column) -> Column:
    parts = filled_parts(name)
    return F.trim(F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise(name))


def city(name: Column) -> Column:
    parts = filled_parts(name)
    return F.trim(F.when(F.size(parts) >= 1, F.element_at(parts, 1)).otherwise(name))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def size_text(n: Column) -> Column:
    k = 1024
    return (
        F.when(n < k, F.format_string("%d B", n))
        .when(n < k**2, F.format_string("%.1f KB", n / k))
        .when(n < k**3, F.format_string("%.1f MB", n / k**2))
        .otherwise(F.format_string("%.2f GB", n / k**3))
    )


def exif_time(text: Column) -> Column:
    """EXIF date text as a timestamp; null where it is short or malformed."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss"))


def dms_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees of degrees, minutes and seconds; S and W are negative."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Autumn").otherwise("Winter")


def fit_within(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """A thumbnail's width and height: the longer side is ``most``, neither under 1."""
    ratio = F.least(most / width, most / height)
    return F.greatest(F.lit(1), (width * ratio).cast("int")), F.greatest(F.lit(1), (height * ratio).cast("int"))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (structs with x, y, w, h): intersection over union."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    inter = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
