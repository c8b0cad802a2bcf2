"""Findings on media timelines: spans of sampled frames, merged findings, masks between neighbouring frames, filter graphs.

A finding is heard (AUDIO), read in subtitles (SUBTITLE) or seen (the other kinds); only what is seen has a box. Merging and
numbering run in windows by stream or file; tracks of what is seen are followed by a stream of sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.scans import running

# Kinds that are seen; how many tracks stay open, and when two boxes may be one thing that has moved.
SEEN = ("OCR_TEXT", "FACE", "LICENSE_PLATE", "QR_CODE")
MOST_TRACKS = 128
LEAST_OVERLAP, LEAST_MOTION, MOTION = 0.02, 32.0, 4.0
PADDING, LEAST_PADDING = 0.08, 3

FINDING = "stream int, kind string, rule_id string, value string, start_ms long, end_ms long, x int, y int, w int, h int, confidence double, label string, context string"
NAMES = tuple(c.split()[0] for c in FINDING.split(", "))


def seen(kind: Column) -> Column:
    return kind.isin(*SEEN)


def frame_span(index: Column, fps: float, duration: Column) -> tuple[Column, Column]:
    """The time that the sampled frame `index` stands for."""
    centre, radius = F.round(index * 1000.0 / fps).cast("long"), max(300, round(600.0 / fps))
    start = F.greatest(centre - radius, F.lit(0))
    return start, F.least(F.greatest(start + 100, duration), centre + radius)


def finding_counts(findings: DataFrame, *by: str) -> DataFrame:
    """How many findings are heard, seen and read in subtitles."""
    return findings.groupBy(*by).agg(F.count_if(F.col("kind") == "AUDIO").alias("audio"), F.count_if(seen(F.col("kind"))).alias("visual"), F.count_if(F.col("kind") == "SUBTITLE").alias("subtitle"))


def merged_findings(findings: DataFrame, gap: int = 800, keys: tuple[str, ...] = (), buckets: int = 1) -> DataFrame:
    """Findings (see FINDING, and `keys` that tell files apart) with those that aren't seen merged: of one stream, kind and rule,
    as long as they lie at most `gap` apart. A merged one has the first value, label and context that aren't blank, the box
    around all, the greatest confidence, and how many there were (n). What is seen stays as it is, since one box for a long
    track would cover far too much."""
    by = [*keys, "stream", "kind", "rule_id"]
    rows = findings.select(*keys, *NAMES)
    unseen = rows.where(~seen(F.col("kind")))
    reach = running(unseen, by, F.col("start_ms"), ["end_ms", "value"], {"_reach": ("max_before", F.col("end_ms"))}, buckets)
    new = F.when(F.col("start_ms") - F.col("_reach") <= gap, 0).otherwise(1)
    marked = running(reach, by, F.col("start_ms"), ["end_ms", "value", "_reach"], {"_island": ("sum", new)}, buckets)
    order = F.struct("start_ms", "end_ms", "value")
    first = lambda c: F.coalesce(F.min_by(F.when(F.trim(c) != "", F.col(c)), F.when(F.trim(c) != "", order)), F.lit("")).alias(c)
    right, low = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    box = (F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (low - F.min("y")).alias("h"))
    joined = marked.groupBy(*by, "_island").agg(first("value"), F.min("start_ms").alias("_s"), F.max("end_ms").alias("end_ms"), *box, F.max("confidence").alias("confidence"), first("label"), first("context"), F.count(F.lit(1)).alias("n"))
    return joined.withColumnRenamed("_s", "start_ms").select(*keys, *NAMES, "n").unionByName(rows.where(seen(F.col("kind"))).withColumn("n", F.lit(1).cast("long")))


class _Tracks:
    """The open tracks of one key, as arrays: middle of the time, box, and the findings themselves."""

    def __init__(self) -> None:
        self.at, self.box, self.rows = np.zeros(0, np.int64), np.zeros((0, 4)), []

    def keep(self, which: np.ndarray) -> None:
        if not which.all():
            self.at, self.box = self.at[which], self.box[which]
            self.rows = [self.rows[i] for i in np.flatnonzero(which)]

    def nearest(self, at: int, box: np.ndarray) -> tuple[int, float] | None:
        """The open track that fits best, and how far its centre is."""
        corner = np.minimum(self.box[:, :2] + self.box[:, 2:], box[:2] + box[2:]) - np.maximum(self.box[:, :2], box[:2])
        shared = np.prod(np.maximum(corner, 0), axis=1)
        whole = np.prod(self.box[:, 2:], axis=1) + box[2] * box[3] - shared
        overlap = np.divide(shared, whole, out=np.zeros(len(shared)), where=whole > 0)
        far = np.hypot(*(self.box[:, :2] + self.box[:, 2:] / 2 - box[:2] - box[2:] / 2).T)
        size = np.maximum(self.box[:, 2:].max(axis=1), box[2:].max())
        fits = (self.at < at) & ((overlap >= LEAST_OVERLAP) | (far <= np.maximum(LEAST_MOTION, MOTION * size)))
        if not fits.any():
            return None
        best = int(np.where(fits, far / np.maximum(size, 1) - overlap, np.inf).argmin())
        return best, float(far[best])

    def add(self, at: int, box: np.ndarray, row: dict) -> None:
        self.at, self.box, self.rows = np.append(self.at, at), np.vstack((self.box, box)), [*self.rows, row]
        if len(self.rows) > MOST_TRACKS:
            self.keep(np.arange(len(self.rows)) > 0)


def _between(a: dict, b: dict, box: np.ndarray, now: np.ndarray, far: float) -> dict:
    """The mask from the middle of one finding to that of the next: a box around both, padded by how far they are apart."""
    pad = max(LEAST_PADDING, int(np.ceil(far * PADDING)))
    corner = np.maximum(np.minimum(box[:2], now[:2]) - pad, 0)
    end = np.maximum(box[:2] + box[2:], now[:2] + now[2:]) + pad
    own = {c: a[c] if (a[c] or "").strip() else b[c] for c in ("value", "context")}
    return a | own | {"start_ms": a["mid"], "end_ms": b["mid"], "x": int(corner[0]), "y": int(corner[1]), "w": int(end[0] - corner[0]), "h": int(end[1] - corner[1]), "confidence": min(a["confidence"], b["confidence"])}


def _tracked(most: int, keys: tuple[str, ...]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tracks = None, _Tracks()
        for part in parts:
            out, boxes = [], part[["x", "y", "w", "h"]].to_numpy(float)
            for now, box in zip(part.to_dict("records"), boxes, strict=True):
                own = tuple(now[c] for c in (*keys, "stream", "kind", "rule_id", "same"))
                if own != key:
                    key, tracks = own, _Tracks()
                tracks.keep(now["mid"] - tracks.at <= most)
                if tracks.rows and (found := tracks.nearest(now["mid"], box)):
                    best, far = found
                    out.append(_between(tracks.rows[best], now, tracks.box[best], box, far))
                    tracks.keep(np.arange(len(tracks.rows)) != best)
                tracks.add(now["mid"], box, now)
            yield pd.DataFrame(out, columns=[*keys, *NAMES])

    return run


def bridges(findings: DataFrame, fps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Masks between findings of one stream, kind, rule and value that are seen in neighbouring sampled frames: each is
    joined to the nearest open one of at most two frames before, each once.

    Tracks are followed in time order inside a key, over sorted partitions, with at most 128 open ones in memory; a key's
    rows pass one task as a stream and are never held."""
    most = 2 * max(100, round(1000.0 / max(0.1, fps)))
    mid = F.col("start_ms") + F.call_function("shiftright", F.col("end_ms") - F.col("start_ms"), F.lit(1))
    rows = findings.where(seen(F.col("kind"))).select(*keys, *NAMES).withColumn("mid", mid).withColumn("same", F.lower(F.trim(F.coalesce("value", F.lit("")))))
    by = (*keys, "stream", "kind", "rule_id", "same")
    placed = rows.repartition(*by).sortWithinPartitions(*by, "mid", "x", "y")
    shape = ", ".join([*(f"{k} {findings.schema[k].dataType.simpleString()}" for k in keys), FINDING])
    return placed.mapInPandas(_tracked(most, keys), shape)


def with_bridges(findings: DataFrame, fps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Findings and their bridges, by stream, start and rule."""
    return findings.select(*keys, *NAMES).unionByName(bridges(findings, fps, keys)).orderBy(*keys, "stream", "start_ms", "rule_id")


def _seconds(c: str) -> Column:
    return F.format_string("%.3f", F.col(c) / 1000.0)


def filter_graph(findings: DataFrame, streams: DataFrame, file: str = "file") -> DataFrame:
    """The lines of each file's filter graph: file, type, place (from 0, within the type), stream, line, label.

    `streams`: file, stream, type (video or audio), width, height. On a video stream what is seen is covered, by boxes cut to
    the frame; on an audio stream what isn't seen is muted. A line takes the label of the stream's line before, the first one
    the stream itself; a stream without findings gets a line that changes nothing. Findings of other streams have no line."""
    rows = findings.select(F.col(file).alias("_f"), F.col("stream").alias("_s"), F.when(seen(F.col("kind")), "video").otherwise("audio").alias("_t"), "rule_id", "value", "start_ms", "end_ms", "x", "y", "w", "h")
    own = streams.where(F.col("type").isin("video", "audio")).select(F.col(file).alias("file"), "stream", "type", "width", "height")
    both = own.join(rows, (F.col("file") == F.col("_f")) & (F.col("stream") == F.col("_s")) & (F.col("type") == F.col("_t")), "left")
    n = F.row_number().over(Window.partitionBy("file", "type").orderBy("stream", "start_ms", "rule_id", "end_ms", "x", "y", "value")) - 1
    named = both.withColumn("place", n).withColumn("label", F.concat(F.substring("type", 1, 1), F.col("place").cast("string")))
    before = F.lag("label").over(Window.partitionBy("file", "type", "stream").orderBy("place"))
    source = F.coalesce(before, F.concat(F.lit("0:"), F.col("stream").cast("string")))
    span = F.concat(F.lit(":enable='between(t,"), _seconds("start_ms"), F.lit(","), _seconds("end_ms"), F.lit(")'"))
    clip = lambda c, low, high: F.least(F.greatest(F.col(c), F.lit(low)), high).cast("int")
    box = F.format_string("drawbox=x=%d:y=%d:w=%d:h=%d:color=black:t=fill", clip("x", 0, F.col("width") - 1), clip("y", 0, F.col("height") - 1), clip("w", 2, F.col("width")), clip("h", 2, F.col("height")))
    video = F.col("type") == "video"
    act = F.when(F.col("start_ms").isNull(), F.when(video, "null").otherwise("anull")).otherwise(F.concat(F.when(video, box).otherwise("volume=0"), span))
    return named.select(F.col("file").alias(file), "type", "place", "stream", F.concat(F.lit("["), source, F.lit("]"), act, F.lit("["), F.col("label"), F.lit("]")).alias("line"), "label")


def filter_scripts(lines: DataFrame, file: str = "file") -> DataFrame:
    """Each file's graph as one text, video lines first: file, script."""
    order = F.struct(F.when(F.col("type") == "video", 0).otherwise(1).alias("t"), F.col("place").alias("p"), F.col("line").alias("l"))
    return lines.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["l"]), ";\n").alias("script"))


def filter_lines(findings: DataFrame, *by: str) -> DataFrame:
    """A line for each finding that tells a media tool when and where to cover the picture or mute the sound; none for subtitles, whose text is rewritten."""
    span = F.concat(F.lit("between(t,"), _seconds("start_ms"), F.lit(","), _seconds("end_ms"), F.lit(")"))
    box = F.format_string("drawbox=x=%d:y=%d:w=%d:h=%d:color=black:t=fill:enable='%s'", F.greatest("x", F.lit(0)), F.greatest("y", F.lit(0)), F.greatest("w", F.lit(2)), F.greatest("h", F.lit(2)), span)
    mute = F.format_string("volume=0:enable='%s'", span)
    return findings.where("kind <> 'SUBTITLE'").select(*by, "start_ms", F.when(seen(F.col("kind")), box).otherwise(mute).alias("line"))


def ignore_key(kind: Column, stream: Column, start_ms: Column, end_ms: Column, *box: Column) -> Column:
    """The key by which a finding is ignored again: its kind, stream, times in tenths of a second and box in steps of four pixels."""
    whole = lambda c, n: F.call_function("div", c.cast("long"), F.lit(n).cast("long"))
    return F.concat_ws(":", F.lit("media"), kind, stream, whole(start_ms, 100), whole(end_ms, 100), *(whole(c, 4) for c in box))


def not_ignored(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    """Findings of which neither the key nor the value (whatever its case) is in the table `ignored` (value)."""
    key = ignore_key(*(F.col(c) for c in ("kind", "stream", "start_ms", "end_ms", "x", "y", "w", "h")))
    exact = ignored.select(F.col("value").alias("_key")).distinct()
    loose = ignored.where("trim(value) <> ''").select(F.lower("value").alias("_low")).distinct()
    rows = findings.join(exact, key == F.col("_key"), "left_anti")
    return rows.join(loose, F.lower("value") == F.col("_low"), "left_anti")
