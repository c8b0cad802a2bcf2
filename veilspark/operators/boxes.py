"""Boxes on images: which words a found span covers, and which detections survive their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.detect import detect
from veilspark.plans.rules import RuleSet

BOX = "struct<x:int,y:int,w:int,h:int,score:double>"


def iou(a: Column, b: Column) -> Column:
    """The shared area of two boxes over the area of both."""
    w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    return F.coalesce(F.try_divide(w * h, a["w"] * a["h"] + b["w"] * b["h"] - w * h), F.lit(0.0))


def suppressed(boxes: Column, least: float = 0.8, overlap: float = 0.3) -> Column:
    """Boxes (x, y, w, h, score) from the highest score down, without those that overlap a better one."""
    good = F.filter(boxes, lambda b: b["score"] >= least)
    ranked = F.reverse(F.array_sort(F.transform(good, lambda b: F.struct(b["score"].alias("s"), b.alias("b")))))
    take = lambda kept, x: F.when(F.exists(kept, lambda k: iou(k, x["b"]) > overlap), kept).otherwise(F.concat(kept, F.array(x["b"])))
    return F.aggregate(ranked, F.array().cast(f"array<{BOX}>"), take)


def word_boxes(words: DataFrame, rules: RuleSet, *line: str) -> DataFrame:
    """Found values in lines of words (row, text, left, top, width, height, conf), with the box around their words and
    the mean of the words' confidences as a share."""
    w = Window.partitionBy(*line).orderBy("row")
    placed = words.withColumn("b", F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text") - 1)
    item = F.struct("row", "b", (F.col("b") + F.length("text")).alias("e"), "left", "top", "width", "height", "conf", "text")
    lines = placed.groupBy(*line).agg(F.array_sort(F.collect_list(item)).alias("words"))
    lines = lines.withColumn("text", F.array_join(F.transform("words", lambda x: x["text"]), " "))
    hits = detect(lines, rules).select(*line, "words", F.explode("found").alias("m"))
    own = hits.withColumn("own", F.filter("words", lambda x: (x["b"] < F.col("m.end")) & (x["e"] > F.col("m.start"))))
    pick = lambda f, g: g(F.transform("own", f))
    left, top = pick(lambda x: x["left"], F.array_min), pick(lambda x: x["top"], F.array_min)
    right, low = pick(lambda x: x["left"] + x["width"], F.array_max), pick(lambda x: x["top"] + x["height"], F.array_max)
    sure = F.filter("own", lambda x: x["conf"] >= 0)
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, x: a + x["conf"]) / F.size(sure) / 100).otherwise(0.0)
    return own.select(*line, "m.rule_id", "m.value", left.alias("left"), top.alias("top"), (right - left).alias("width"), (low - top).alias("height"), mean.alias("confidence"))


def glyph_boxes(spans: DataFrame, glyphs: DataFrame, key: str, reach: int = 64) -> DataFrame:
    """The boxes of spans in text whose characters have places: key, start, end, line, x, y, w, h, glyphs.

    `spans`: key, start, end (offsets, end beyond the last); `glyphs`: key, at (offset), line, x, y, w, h. Both meet on equal key
    and stretch of `reach` offsets, so a page's spans aren't compared with all its glyphs, and a page with very many of both is
    many keys. A span over several lines has a box on each; glyphs without width or height have none; a span without glyphs
    gives no row, and equal spans one."""
    cut = spans.select(key, "start", "end").where("end > start").distinct()
    first, last = F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach)
    parts = cut.withColumn("_b", F.explode(F.sequence(first, last)))
    placed = glyphs.where("w > 0 AND h > 0").select(F.col(key).alias("_k"), F.floor(F.col("at") / reach).alias("_g"), "at", "line", "x", "y", "w", "h")
    # page and glyphs look small to the optimizer, which sees the columns they are made from; sorted, neither is sent to the driver
    met = parts.hint("merge").join(placed, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_g")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    right, low = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return met.groupBy(key, "start", "end", "line").agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (low - F.min("y")).alias("h"), F.count(F.lit(1)).alias("glyphs"))
