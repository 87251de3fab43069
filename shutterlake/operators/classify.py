"""Rules that sort media files into categories by folder, name and metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

# Rules as (text, category, confidence), in the order they apply.
FOLDER_RULES = [
    ("whatsapp images", "WhatsAppImage", 0.95),
    ("whatsapp video", "WhatsAppVideo", 0.95),
    ("whatsapp image", "WhatsAppImage", 0.90),
    ("telegram images", "TelegramImage", 0.95),
    ("telegram video", "TelegramVideo", 0.95),
    ("telegram image", "TelegramImage", 0.90),
    ("downloads", "DownloadedImage", 0.70),
    ("download", "DownloadedImage", 0.65),
    ("screenshots", "Screenshot", 0.95),
    ("screenshot", "Screenshot", 0.90),
    ("dcim", "CameraPhoto", 0.80),
    ("camera", "CameraPhoto", 0.75),
    ("instagram", "SocialMediaImage", 0.85),
    ("instasave", "SocialMediaImage", 0.90),
    ("facebook", "SocialMediaImage", 0.80),
    ("twitter", "SocialMediaImage", 0.80),
    ("snapchat", "SocialMediaImage", 0.80),
    ("tiktok", "SocialMediaVideo", 0.85),
    ("memes", "Meme", 0.90),
    ("meme", "Meme", 0.85),
    ("screen recordings", "ScreenRecording", 0.95),
    ("screen recording", "ScreenRecording", 0.90),
]
PREFIX_RULES = [
    ("img_", "CameraPhoto", 0.70),
    ("dsc_", "CameraPhoto", 0.80),
    ("dscn", "CameraPhoto", 0.80),
    ("p10", "CameraPhoto", 0.75),
    ("mvimg", "CameraPhoto", 0.75),
    ("vid_", "CameraVideo", 0.70),
    ("mp4", "CameraVideo", 0.60),
    ("whatsapp image", "WhatsAppImage", 0.90),
    ("whatsapp video", "WhatsAppVideo", 0.90),
    ("wa ", "WhatsAppImage", 0.70),
    ("screenshot_", "Screenshot", 0.90),
    ("screenshot ", "Screenshot", 0.85),
    ("screen shot", "Screenshot", 0.85),
    ("capture", "Screenshot", 0.70),
    ("telegram", "TelegramImage", 0.80),
    ("instasave", "SocialMediaImage", 0.90),
    ("fb_", "SocialMediaImage", 0.75),
    ("ig_", "SocialMediaImage", 0.80),
    ("snap", "SocialMediaImage", 0.70),
    ("download", "DownloadedImage", 0.60),
    ("meme", "Meme", 0.80),
]
CONTAINS_RULES = [
    ("whatsapp", "WhatsAppImage", 0.80),
    ("telegram", "TelegramImage", 0.75),
    ("screenshot", "Screenshot", 0.85),
    ("screenrecording", "ScreenRecording", 0.90),
    ("instasave", "SocialMediaImage", 0.90),
    ("insta", "SocialMediaImage", 0.70),
    ("facebook", "SocialMediaImage", 0.70),
    ("twitter", "SocialMediaImage", 0.70),
    ("snapchat", "SocialMediaImage", 0.70),
    ("tiktok", "SocialMediaVideo", 0.80),
    ("meme", "Meme", 0.80),
    ("funny", "Meme", 0.50),
    ("lol", "Meme", 0.40),
]
VIDEO_TWIN = {
    "CameraPhoto": "CameraVideo",
    "WhatsAppImage": "WhatsAppVideo",
    "TelegramImage": "TelegramVideo",
    "DownloadedImage": "DownloadedVideo",
    "SocialMediaImage": "SocialMediaVideo",
}
METADATA_CONFIDENCE = 0.85
MESSAGING = ("WhatsAppImage", "WhatsAppVideo", "TelegramImage", "TelegramVideo")
CLUTTER = ("Meme", "Screenshot", "ScreenRecording")
LOW_QUALITY = ("DownloadedImage", "DownloadedVideo", "SocialMediaImage", "SocialMediaVideo")

_SIGNAL = "array<struct<ord:int,type:string,value:string,category:string,confidence:double>>"


def _signal(order: int, kind: str, value: Column | str, category: Column | str, confidence: float) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("type"), as_column(value).alias("value"), as_column(category).alias("category"), F.lit(confidence).alias("confidence"))


def signals(folder: Column, name: Column, ext: Column, make: Column, model: Column, lat: Column, lon: Column) -> Column:
    """All signals of a file in rule order: the first folder rule, the first
    prefix rule, every contains rule, then metadata."""
    path, low = F.lower(F.replace(folder, F.lit("\\"), F.lit("/"))), F.lower(name)

    def first(rules, start: int, kind: str, holds) -> Column:
        hit = reduce(lambda rest, r: F.when(holds(r[1][0]), _signal(start + r[0], kind, *r[1])).otherwise(rest), reversed(list(enumerate(rules))), F.lit(None))
        return F.array_compact(F.array(hit))

    contained = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), _signal(200 + i, "FilenameContains", t, c, s)) for i, (t, c, s) in enumerate(CONTAINS_RULES)]))
    camera = F.when(S.is_video(ext), "CameraVideo").otherwise("CameraPhoto")
    known = (F.coalesce(make, F.lit("")) != "") | (F.coalesce(model, F.lit("")) != "") | (lat.isNotNull() & lon.isNotNull())
    meta = F.array_compact(F.array(F.when(known, _signal(300, "Metadata", F.coalesce(make, F.lit("Unknown")), camera, METADATA_CONFIDENCE))))
    parts = [
        first(FOLDER_RULES, 0, "FolderPath", lambda t: F.contains(path, F.lit(t))),
        first(PREFIX_RULES, 100, "FilenamePrefix", lambda t: F.startswith(low, F.lit(t))),
        contained,
        meta,
    ]
    empty = F.array().cast(_SIGNAL)
    return F.concat(*[F.coalesce(p.cast(_SIGNAL), empty) for p in parts])


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, wherever and how often ``use`` takes it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _verdict(found: Column, video: Column) -> Column:
    met = lambda s: F.array_min(F.transform(F.filter(found, lambda o: o["category"] == s["category"]), lambda o: o["ord"]))
    best = F.array_min(F.transform(found, lambda s: F.struct((-s["confidence"]).alias("k"), met(s).alias("met"), s["category"].alias("category"))))
    twins = F.create_map(*[F.lit(x) for pair in VIDEO_TWIN.items() for x in pair])

    def named(b):
        twin = F.when(video, F.coalesce(F.try_element_at(twins, b["category"]), b["category"])).otherwise(b["category"])
        sure = F.when(b.isNull(), 0.0).otherwise(F.least(-b["k"], F.lit(1.0)))
        return F.struct(found.alias("signals"), F.coalesce(twin, F.lit("Unknown")).alias("category"), sure.alias("confidence"))

    return _let(best, named)


def classify(photos: DataFrame) -> DataFrame:
    """``photos`` with ``signals``, ``category`` and ``confidence``.

    A category scores its surest signal; the surest category wins, ties going
    to the one met first. Videos take the video twin of the winner, where there
    is one. Without a signal: Unknown at 0. All of it is one expression, in
    which each step is bound once: filters on its parts do not multiply it.
    """
    found = signals(*[F.col(c) for c in ("folder_path", "file_stem", "ext", "camera_make", "camera_model", "lat", "lon")])
    out = photos.withColumn("_class", _let(found, lambda s: _verdict(s, S.is_video(F.col("ext")))))
    return out.withColumns({c: F.col(f"_class.{c}") for c in ("signals", "category", "confidence")}).drop("_class")


def classify_new(photos: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` (key, category, confidence, classified_at) with classes for the
    photos that have no ``classified_at`` yet; only these are classified. Photos
    that ``stored`` does not know count as new."""
    done = stored.where("classified_at IS NOT NULL")
    fresh = classify(photos.join(done.select(key), key, "left_anti")).select(key, "category", "confidence", F.lit(True).alias("is_new"))
    return done.select(key, "category", "confidence", F.lit(False).alias("is_new")).unionByName(fresh)


def cleanup_categories(classified: DataFrame) -> DataFrame:
    """Files and bytes per category other than Unknown, which goes after the aggregation."""
    return classified.groupBy("category").agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size")).where("category <> 'Unknown'")


def cleanup_statistics(classified: DataFrame) -> DataFrame:
    """One row: files, classified files, their rate in percent, bytes, classified bytes."""
    known = F.col("category") != "Unknown"
    out = classified.agg(
        F.count("*").alias("total_files"), F.count_if(known).alias("classified_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.coalesce(F.sum(F.when(known, F.col("file_size"))), F.lit(0)).alias("classifiable_size")
    )
    return out.withColumn("rate", F.when(F.col("total_files") > 0, F.col("classified_files") * 100.0 / F.col("total_files")).otherwise(F.lit(0.0)))


def cleanup_buckets(categories: DataFrame) -> DataFrame:
    """One row: files from messengers, clutter, and files of low quality."""
    some = lambda names: F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("file_count"))), F.lit(0))
    out = categories.agg(some(MESSAGING).alias("messaging"), some(CLUTTER).alias("clutter"), some(LOW_QUALITY).alias("low_quality"))
    return out.withColumn("total_issues", F.expr("messaging + clutter + low_quality"))
