"""Running sums, maxima and previous values in two levels, so that a key with a third of all rows is many tasks.

A window over a key is one task for that key, however long it is. Here rows are dealt by key and bucket, where buckets are
ranges of the time (or whatever rows are ordered by first) that hold about equally many rows of the table. A window inside
each (key, bucket) gives what is known there; one row for each (key, bucket) sums it up; a window over these few rows says
what each bucket starts with; and that is joined back by (key, bucket). So a key with a share s of the rows is spread over
about s * `buckets` tasks, and no task sorts more than its bucket. Bounds come from one pass of approximate percentiles; only
they reach the driver, `buckets` - 1 numbers.

Defined cases: rows are ordered by `at`, then by the other order columns, nulls first; rows of one `at` share a bucket, so
many equal times are not split. Null keys are a key. A null value adds nothing to a sum or maximum; as a previous value it is
a null that is there. An empty table gives no row. Column names of the table are kept; those beginning with an underscore and
"scan" are this module's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets where none are given: a hot key with a third of the rows is spread over 20 tasks.
BUCKETS = 60
#: What can run: sums and maxima up to and with a row, or of the rows before it, and the previous row's value.
KINDS = ("sum", "max", "sum_before", "max_before", "previous")


def bounds_of(df: DataFrame, at: Column, buckets: int) -> list:
    """Numbers that part `at` into about equally full ranges."""
    if buckets < 2:
        return []
    got = df.agg(F.percentile_approx(at, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("x")).first().x
    return sorted({x for x in got or [] if x is not None})


def bucket(at: Column, bounds: list) -> Column:
    """How many bounds lie below `at`, by a tree of comparisons; null is below all."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at > bounds[middle], among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(bounds))


def running(df: DataFrame, keys: list[str], at: Column, order: list[Column | str], values: dict[str, tuple[str, Column]], buckets: int = BUCKETS) -> DataFrame:
    """`df` with a column for each of `values`: name -> (kind, column), over the rows of equal `keys`.

    `at` is a number that rises with the order (seconds, a place); `order` orders the rows of one `at`."""
    if any(kind not in KINDS for kind, _ in values.values()):
        raise ValueError(f"kinds are {KINDS}")
    bounds = bounds_of(df, at, buckets)
    names = df.columns
    own = {f"_scan_{i}": c for i, (_, c) in enumerate(values.values())}
    rows = df.withColumns({"_scan_at": at, **own, "_scan_b": bucket(at, bounds)})
    within = Window.partitionBy(*keys, "_scan_b").orderBy("_scan_at", *order)
    upto, before = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    first, sums, carry = {}, {}, {}
    over = Window.partitionBy(*keys).orderBy("_scan_b").rowsBetween(Window.unboundedPreceding, -1)
    for i, (kind, _) in enumerate(values.values()):
        c, total = F.col(f"_scan_{i}"), f"_scan_t{i}"
        if kind == "previous":
            first[f"_scan_w{i}"] = F.lag(F.struct(c.alias("v"))).over(within)
            sums[total] = F.max_by(F.struct(c.alias("v")), F.struct("_scan_at", *order))
            carry[total] = F.last(total, ignorenulls=True).over(over)
        else:
            f = F.sum if kind.startswith("sum") else F.max
            first[f"_scan_w{i}"] = f(c).over(before if kind.endswith("before") else upto)
            sums[total], carry[total] = f(c), f(total).over(over)
    here = rows.withColumns(first)
    if not bounds:
        start = {t: F.lit(None) for t in sums}
        joined = here
    else:
        totals = rows.groupBy(*keys, "_scan_b").agg(*(c.alias(n) for n, c in sums.items()))
        begin = totals.select(*(F.col(k).alias(f"_scan_k{j}") for j, k in enumerate(keys)), F.col("_scan_b").alias("_scan_bb"), *(carry[t].alias(f"{t}_") for t in sums))
        same = [here[k].eqNullSafe(begin[f"_scan_k{j}"]) for j, k in enumerate(keys)]
        joined = here.join(begin, [*same, here["_scan_b"] == begin["_scan_bb"]], "left")
        start = {t: F.col(f"{t}_") for t in sums}
    out = {}
    for i, (name, (kind, _)) in enumerate(values.items()):
        now, old = F.col(f"_scan_w{i}"), start[f"_scan_t{i}"]
        if kind == "previous":
            out[name] = F.coalesce(now, old)["v"] if bounds else now["v"]
        elif kind.startswith("sum"):
            out[name] = F.when(now.isNull(), old).when(old.isNull(), now).otherwise(now + old) if bounds else now
        else:
            out[name] = F.greatest(now, old) if bounds else now
    return joined.select(*(F.col(n) for n in names if n not in out), *(c.alias(n) for n, c in out.items()))


def peaks(changes: DataFrame, keys: list[str], at: Column, order: list[Column | str], delta: Column, buckets: int = BUCKETS) -> DataFrame:
    """`changes` with how much each key holds after each change (`held`), and the most it has held so far (`peak`, 0 at least)."""
    held = running(changes, keys, at, order, {"held": ("sum", delta)}, buckets)
    return running(held, keys, at, order, {"peak": ("max", F.greatest(F.coalesce("held", F.lit(0)), F.lit(0)))}, buckets)
