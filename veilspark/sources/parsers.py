"""Structured outputs of other tools as DataFrames: subtitles, OCR words, speech JSON, archive listings."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUE = r"(?ms)^\s*\d+\s*\r?\n(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})[^\r\n]*\r?\n(.*?)(?=\r?\n\s*\r?\n|\z)"


def milliseconds(stamp: Column) -> Column:
    p = F.split(stamp, "[:,.]")
    part = lambda i: F.get(p, F.lit(i)).cast("long")
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + F.rpad(F.get(p, F.lit(3)), 3, "0").cast("long")


def srt_cues(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """A row for each subtitle cue: keys, cue (from 0), start_ms, end_ms, text without tags."""
    parts = F.arrays_zip(*(F.regexp_extract_all(F.col(text), F.lit(CUE), F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "b"), (3, "t"))))
    cues = df.select(*keys, F.posexplode(parts).alias("cue", "x"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("x.t", "<[^>]{1,200}>", " "), r"[\r\n\t]+", " "))
    return cues.select(*keys, "cue", milliseconds(F.col("x.a")).alias("start_ms"), milliseconds(F.col("x.b")).alias("end_ms"), clean.alias("text"))


def ocr_words(df: DataFrame, tsv: str, *keys: str) -> DataFrame:
    """Words of an OCR table in tab-separated form; the header and broken rows are left out."""
    line = df.select(*keys, F.posexplode(F.split(tsv, "\r?\n")).alias("row", "line")).withColumn("f", F.split("line", "\t", 12))
    get = lambda i: F.get("f", F.lit(i))
    names = ("level", "page", "block", "par", "line_no", "word", "left", "top", "width", "height")
    out = line.where(F.size("f") == 12).select(*keys, "row", *(get(i).try_cast("int").alias(n) for i, n in enumerate(names)), get(10).try_cast("double").alias("conf"), get(11).alias("text"))
    return out.where(F.col("level").isNotNull() & F.col("left").isNotNull() & (F.trim("text") != ""))


SPEECH = "struct<transcription:array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>,tokens:array<struct<p:double>>>>>"


def speech_segments(df: DataFrame, json: str, *keys: str) -> DataFrame:
    """Segments of a transcription: padded by 250 ms, at least 100 ms long, with the mean of the token probabilities."""
    seg = df.select(*keys, F.explode(F.from_json(json, SPEECH)["transcription"]).alias("x"))
    good = F.filter(F.col("x.tokens"), lambda t: t["p"].between(0, 1))
    mean = F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, t: a + t["p"]) / F.size(good)).otherwise(0.0)
    start = F.greatest(F.col("x.offsets.from") - 250, F.lit(0))
    return seg.select(*keys, F.col("x.text").alias("text"), start.alias("start_ms"), F.greatest(start + 100, F.col("x.offsets.to") + 250).alias("end_ms"), mean.alias("confidence"))


def _listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for path, content in zip(part["path"], part["content"]):
            data = io.BytesIO(content)
            if zipfile.is_zipfile(data):
                with zipfile.ZipFile(data) as z:
                    rows += [(path, i, x.filename, x.is_dir(), x.file_size, x.compress_size) for i, x in enumerate(z.infolist())]
                continue
            data.seek(0)
            try:
                with tarfile.open(fileobj=data) as t:
                    rows += [(path, i, x.name, x.isdir(), x.size, -1) for i, x in enumerate(t)]
            except tarfile.TarError:
                rows.append((path, -1, None, False, -1, -1))
        yield pd.DataFrame(rows, columns=["archive", "entry", "path", "directory", "size", "compressed"])


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of zip and tar archives below `path`, in their order; entry -1 where a file isn't one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_listed, "archive string, entry int, path string, directory boolean, size long, compressed long")
