"""Number plates from a detector's raw outputs: the grid of priors, decoded corners, clipped boxes, suppression.

The model itself isn't run here: its outputs are a table, a row for each frame and prior. The grid is made by exploding four
rows, one a level; outputs meet it in a join with these few thousand priors. Frames are told apart by a key; suppression works
on the boxes of one frame that score enough, at most one a prior.

Defined cases: outputs with a null or short array, or of a prior that the grid lacks, are left out; so are boxes that are less
than two pixels wide or high after clipping. Of equal scores the smaller prior comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.boxes import iou

# The model's input, its levels (step, sizes), where the corners stand among its outputs, scale, thresholds, padding.
INPUT = (320, 240)
GRID = ((8, (10, 16, 24)), (16, (32, 48)), (32, (64, 96)), (64, (128, 192, 256)))
CORNERS, VARIANCE = (4, 6, 10, 12), 0.1
LEAST, OVERLAP = 0.80, 0.30
PADDING, LEAST_PADDING, LEAST_SIDE = 0.08, 4, 2


def priors(spark: SparkSession) -> DataFrame:
    """The grid: prior (its number), cx, cy, w, h, as shares of the input."""
    levels, first = [], 0
    for step, sizes in GRID:
        columns, rows = INPUT[0] // step, INPUT[1] // step
        levels.append((first, step, columns, rows, list(sizes)))
        first += columns * rows * len(sizes)
    grid = spark.createDataFrame(levels, "first int, step int, columns int, rows int, sizes array<int>")
    cells = grid.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("columns") * F.col("rows") - 1))).select("*", F.posexplode("sizes").alias("i", "size"))
    centre = lambda at: (at + 0.5) * F.col("step")
    row = F.floor(F.col("cell") / F.col("columns"))
    return cells.select((F.col("first") + F.col("cell") * F.size("sizes") + F.col("i")).alias("prior"), (centre(F.col("cell") % F.col("columns")) / INPUT[0]).alias("cx"), (centre(row) / INPUT[1]).alias("cy"), (F.col("size") / INPUT[0]).alias("w"), (F.col("size") / INPUT[1]).alias("h"))


def clipped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A padded box cut to the frame (x, y, w, h); null if hardly anything is left of it."""
    pad = lambda side: F.greatest(F.lit(LEAST_PADDING), F.floor(side * PADDING + 0.5).cast("int"))
    left, top = (F.greatest(F.lit(0), F.floor(at).cast("int") - pad(side)) for at, side in ((x, w), (y, h)))
    right, low = (F.least(most, F.ceil(at + side).cast("int") + pad(side)) for at, side, most in ((x, w, width), (y, h, height)))
    box = F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (low - top).alias("h"))
    return F.when((right - left >= LEAST_SIDE) & (low - top >= LEAST_SIDE), box)


def plate_score(confidence: Column, overlap: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), confidence.cast("double")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), overlap.cast("double"))))


def decoded(outputs: DataFrame, *keys: str, least: float = LEAST) -> DataFrame:
    """Of outputs (keys, prior, location: 14 numbers, confidence: 2, iou: 1), those that score `least`: keys, prior, score, and box in the model's input."""
    score = plate_score(F.get("confidence", F.lit(1)), F.col("iou"))
    good = outputs.where((F.size("location") >= 14) & (F.size("confidence") >= 2)).withColumn("score", score).where(F.col("score") >= least)
    rows = good.join(F.broadcast(priors(outputs.sparkSession).withColumnRenamed("prior", "_prior")), F.col("prior") == F.col("_prior"))  # a fixed grid
    at = lambda i: F.get("location", F.lit(i)).cast("double") * VARIANCE
    xs = [(F.col("cx") + at(i) * F.col("w")) * INPUT[0] for i in CORNERS]
    ys = [(F.col("cy") + at(i + 1) * F.col("h")) * INPUT[1] for i in CORNERS]
    sides = rows.select(*keys, "prior", "score", F.least(*xs).alias("_x"), F.least(*ys).alias("_y"), F.greatest(*xs).alias("_r"), F.greatest(*ys).alias("_l"))
    box = clipped(F.col("_x"), F.col("_y"), F.col("_r") - F.col("_x"), F.col("_l") - F.col("_y"), *map(F.lit, INPUT))
    return sides.select(*keys, "prior", "score", box.alias("box")).where("box IS NOT NULL")


def plates(outputs: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """The plates of each frame (`frames`: key, width, height), in its own pixels: key, x, y, w, h, confidence."""
    own = decoded(outputs, key)
    ranked = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("prior").alias("p"), F.col("box").alias("b")))).alias("boxes"))  # at most one a prior
    none = F.array().cast("array<struct<s:double,p:int,b:struct<x:int,y:int,w:int,h:int>>>")
    take = lambda kept, x: F.when(F.exists(kept, lambda k: iou(k["b"], x["b"]) > OVERLAP), kept).otherwise(F.concat(kept, F.array(x)))
    kept = ranked.select(key, F.explode(F.aggregate("boxes", none, take)).alias("k")).join(frames.select(key, "width", "height"), key)
    sx, sy = F.col("width") / INPUT[0], F.col("height") / INPUT[1]
    scaled = clipped(F.col("k.b.x") * sx, F.col("k.b.y") * sy, F.col("k.b.w") * sx, F.col("k.b.h") * sy, F.col("width"), F.col("height"))
    return kept.select(key, scaled.alias("b"), F.least(F.lit(1.0), -F.col("k.s")).alias("confidence")).where("b IS NOT NULL").select(key, "b.x", "b.y", "b.w", "b.h", "confidence")
