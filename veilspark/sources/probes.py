"""What other tools and file headers say about media: streams of a probe, sizes of images, regions found by a vision model."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBE = """struct<format:struct<duration:string,format_name:string>,streams:array<struct<index:int,codec_type:string,codec_name:string,width:int,
height:int,duration:string,avg_frame_rate:string,sample_rate:string,channels:int,disposition:struct<attached_pic:int>>>>"""
# Limits of media files.
MOST_STREAMS, MOST_INDEX, MOST_AUDIO, MOST_SUBTITLES = 64, 10_000, 8, 16
MOST_VIDEO_MS, MOST_AUDIO_MS = 30 * 60_000, 4 * 60 * 60_000
MOST_WIDTH, MOST_HEIGHT, MOST_RATE = 4_096, 2_160, 60
AUDIO_FILES, SINGLE_AUDIO, SUBTITLED = ("mp3", "wav", "m4a", "flac"), ("mp3", "wav", "flac"), ("mp4", "mov", "mkv")
# Limits of images.
MOST_PIXELS, MOST_SIDE = 100_000_000, 32_768
# What a vision model may report, and how large a region may be.
REGION_TYPES = ("sensitive_text", "identity_document", "bank_card", "vehicle_plate", "property_document", "face", "signature", "fingerprint", "qr_code")
MOST_REGIONS, LEAST_AREA, MOST_SHARE = 200, 16, 85


def _millis(seconds: Column) -> Column:
    s = seconds.try_cast("double")
    return F.when((s > 0) & (s < 9e15), F.floor(s * 1000 + 0.5)).otherwise(F.lit(-1)).cast("long")


def _rate(text: Column) -> Column:
    part = F.split(text, "/", 2)
    above, below = F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double")
    return F.coalesce(F.when(text.contains("/"), F.try_divide(above, below)).otherwise(text.try_cast("double")), F.lit(-1.0))


def probed(df: DataFrame, json: str, *keys: str, name: str | None = None) -> DataFrame:
    """A row for each probe in JSON: keys, format, duration_ms (the container's, else the longest stream's, else -1), streams,
    and problems: why the file isn't processed. `name` is the column of the file's name, whose type limits its streams."""
    p = F.from_json(json, PROBE)

    def stream(s: Column) -> Column:
        number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
        return F.struct(
            F.coalesce(s["index"], F.lit(-1)).alias("index"),
            F.lower(F.coalesce(s["codec_type"], F.lit(""))).alias("type"),
            F.lower(F.coalesce(s["codec_name"], F.lit(""))).alias("codec"),
            _millis(s["duration"]).alias("duration_ms"),
            *(number(s[c]).alias(c) for c in ("width", "height")),
            _rate(s["avg_frame_rate"]).alias("fps"),
            *(number(s[c]).alias(c) for c in ("sample_rate", "channels")),
            F.coalesce(s["disposition"]["attached_pic"] == 1, F.lit(False)).alias("picture"),
        )

    own = [F.col(name).alias("_name")] if name else [F.lit(None).cast("string").alias("_name")]
    rows = df.select(*keys, *own, p.alias("_p")).withColumn("streams", F.transform("_p.streams", stream)).withColumn("format", F.coalesce("_p.format.format_name", F.lit("")))
    whole = _millis(F.col("_p.format.duration"))
    longest = F.coalesce(F.array_max(F.transform("streams", lambda s: s["duration_ms"])), F.lit(-1).cast("long"))
    rows = rows.withColumn("duration_ms", F.when(whole > 0, whole).otherwise(longest))
    of = lambda kind: F.filter("streams", lambda s: (s["type"] == kind) & ~(s["picture"] & F.lit(kind == "video")))
    rows = rows.withColumns({"_v": of("video"), "_a": of("audio"), "_s": of("subtitle")})
    v, a, s, ext = F.size("_v"), F.size("_a"), F.size("_s"), F.lower(F.regexp_extract("_name", r"\.([^.]+)$", 1))
    lasts = F.col("duration_ms")
    checks = {
        "no streams": F.col("streams").isNull() | (F.size("streams") > MOST_STREAMS),
        "stream index": F.exists("streams", lambda x: ~x["index"].between(0, MOST_INDEX)),
        "no video or audio": (v == 0) & (a == 0),
        "several videos": v > 1,
        "too many audio streams": a > MOST_AUDIO,
        "too many subtitles": s > MOST_SUBTITLES,
        "no duration": lasts <= 0,
        "too long": lasts > F.when(v == 0, MOST_AUDIO_MS).otherwise(MOST_VIDEO_MS),
        "picture size": F.exists("_v", lambda x: ~(x["width"].between(1, MOST_WIDTH) & x["height"].between(1, MOST_HEIGHT))),
        "frame rate": F.exists("_v", lambda x: ~((x["fps"] > 0) & (x["fps"] <= MOST_RATE))),
        "video in an audio file": ext.isin(*AUDIO_FILES) & (v > 0),
        "several audio streams": ext.isin(*SINGLE_AUDIO) & (a > 1),
        "subtitles": F.col("_name").isNotNull() & ~ext.isin(*SUBTITLED) & (s > 0),
    }
    problems = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), k) for k, c in checks.items())))
    return rows.select(*keys, "format", "duration_ms", "streams", problems.alias("problems"))


def sample_rate(duration_ms: Column, wanted: float = 1.0, most: int = 900) -> Column:
    """Frames a second that are looked at: as many as wanted (0.1 to 5), at most `most` of a file, at least 0.1."""
    seconds = F.greatest(F.lit(1.0), duration_ms / 1000.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(min(max(wanted, 0.1), 5.0)), F.lit(float(most)) / seconds))


def _size(data: bytes) -> tuple[str | None, int | None, int | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return "bmp", width, abs(height)
    if data[:4] == b"GIF8" and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    at = 2 if data[:3] == b"\xff\xd8\xff" else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return "jpeg", width, height
        at += 1 if mark == 0xFF else 2 if mark == 1 or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None, None, None


def _sizes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [(path, *_size(bytes(content if content is not None else b""))) for path, content in zip(part["path"], part["content"])]
        yield pd.DataFrame(rows, columns=["path", "format", "width", "height"])


def image_sizes(files: DataFrame) -> DataFrame:
    """What the headers of images (path, content) say: path, format, width, height, pixels, and whether they may be decoded;
    nulls and false for a file that is no image."""
    got = files.select("path", "content").mapInPandas(_sizes, "path string, format string, width long, height long")
    got = got.withColumn("pixels", F.col("width") * F.col("height"))
    fits = F.col("width").between(1, MOST_SIDE) & F.col("height").between(1, MOST_SIDE) & (F.col("pixels") <= MOST_PIXELS)
    return got.withColumn("allowed", F.coalesce(fits, F.lit(False)))


REGIONS = "struct<findings:array<struct<type:string,label:string,bbox:array<double>,confidence:double>>>"


def model_regions(df: DataFrame, json: str, width: str, height: str, *keys: str) -> DataFrame:
    """A row for each region that a vision model reports in thousandths of an image's sides: keys, region (its place in the
    answer), type, label, x, y, w, h in pixels, confidence, and too_many (the answer has more than 200 good regions and is
    refused). Unknown types, broken boxes and regions under 16 pixels or over 85 % of the image are left out."""
    rows = df.select(*keys, F.col(width).alias("_w"), F.col(height).alias("_h"), F.posexplode(F.from_json(json, REGIONS)["findings"]).alias("region", "_x"))
    side = lambda i: F.get("_x.bbox", F.lit(i))
    good = F.lower("_x.type").isin(*REGION_TYPES) & (F.size("_x.bbox") == 4) & (side(0) >= 0) & (side(1) >= 0) & (side(2) > side(0)) & (side(3) > side(1)) & (side(2) <= 1000) & (side(3) <= 1000)
    low = lambda i, s: F.least(F.floor(side(i) / 1000.0 * F.col(s)), F.col(s) - 1).cast("int")
    rows = rows.where(good).withColumns({"x": low(0, "_w"), "y": low(1, "_h")})
    high = lambda i, s, o: F.least(F.greatest(F.ceil(side(i) / 1000.0 * F.col(s)), F.col(o) + 1), F.col(s)).cast("int")
    rows = rows.withColumns({"w": high(2, "_w", "x") - F.col("x"), "h": high(3, "_h", "y") - F.col("y")})
    area = F.col("w").cast("long") * F.col("h")
    rows = rows.where((area >= LEAST_AREA) & (area * 100 <= F.col("_w").cast("long") * F.col("_h") * MOST_SHARE))
    kind = F.lower("_x.type")
    label = F.substring(F.trim(F.regexp_replace(F.coalesce("_x.label", kind), r"[\r\n\t]+", " ")), 1, 120)
    sure = F.least(F.greatest(F.coalesce("_x.confidence", F.lit(0.75)), F.lit(0.0)), F.lit(1.0))
    rows = rows.select(*keys, "region", kind.alias("type"), label.alias("label"), "x", "y", "w", "h", sure.alias("confidence"))
    many = rows.groupBy(*keys).agg((F.count(F.lit(1)) > MOST_REGIONS).alias("too_many"))
    return rows.join(many, list(keys))
