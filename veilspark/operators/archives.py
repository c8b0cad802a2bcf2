"""Archive entries: what they are, which limits they break, what is done with them, and the summary of a result.

Entries have (archive, entry, path, directory, size, compressed) and, if known, readable and link. An archive of any size
is only ever aggregated; the running number of bytes is a window over one archive, which has 10,000 entries at most before
it is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.scans import running

from veilspark.operators.reports import archive_category, archive_reason, safe_path

# Limits of entries, and reasons that go before that of the category.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_BYTES, MOST_RATIO = 10_000, 1 << 30, 8 << 30, 200
UNSAFE_PATH = "路径不安全，可能逃逸压缩包工作目录"
IS_LINK = "符号链接或硬链接不允许解压"
UNREADABLE = "条目可能已加密或使用当前运行时不支持的压缩算法"
ACTIONS = ("REDACT", "EXCLUDE", "KEEP_UNPROCESSED")


def too_dense(size: Column, compressed: Column) -> Column:
    """Whether an entry unpacks to more than 200 times its bytes; by whole numbers, so nothing is rounded."""
    return F.coalesce((size > 0) & (compressed > 0) & (size > compressed * MOST_RATIO), F.lit(False))


def inspected(entries: DataFrame) -> DataFrame:
    """`entries` with category, reason, safe, by_default (is processed unless the user says otherwise), may_keep and flags
    (the limits that the entry breaks)."""
    readable = F.col("readable") if "readable" in entries.columns else F.lit(True)
    link = F.col("link") if "link" in entries.columns else F.lit(False)
    safe = safe_path(F.col("path"))
    category = F.when(~safe | link, "DANGEROUS").when(~readable, "UNSUPPORTED").otherwise(archive_category(F.col("path"), F.col("directory")))
    out = entries.withColumn("safe", safe).withColumn("category", category)
    reason = F.when(~F.col("safe"), UNSAFE_PATH).when(link, IS_LINK).when(~readable, UNREADABLE).otherwise(archive_reason(F.col("category")))
    size, packed = F.col("size"), F.col("compressed")
    flags = F.array_compact(F.array(F.when(F.col("entry") >= MOST_ENTRIES, "too_many"), F.when(size > MOST_ENTRY_BYTES, "too_large"), F.when(too_dense(size, packed), "too_dense")))
    usable = F.col("safe") & readable & ~F.col("directory")
    return out.withColumns({"reason": reason, "by_default": usable & (F.col("category") == "REDACTABLE"), "may_keep": usable & (F.col("category") != "DANGEROUS"), "flags": flags})


def verdicts(entries: DataFrame) -> DataFrame:
    """A row for each archive: entries, bytes, the counts of its categories that matter, and why it is rejected (empty: it isn't)."""
    e = inspected(entries)
    got = e.groupBy("archive").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.greatest("size", F.lit(0))).alias("bytes"),
        F.count_if("by_default").alias("redactable"),
        F.count_if(F.col("category") == "DANGEROUS").alias("dangerous"),
        *(F.bool_or(F.array_contains("flags", f)).alias(f) for f in ("too_many", "too_large", "too_dense")),
    )
    rejected = F.array_compact(F.array(*(F.when(F.col(f), f) for f in ("too_many", "too_large", "too_dense")), F.when(F.col("bytes") > MOST_BYTES, "too_much")))
    return got.withColumn("rejected", F.array_join(rejected, ",")).drop("too_many", "too_large", "too_dense")


def running_bytes(entries: DataFrame, buckets: int = 1) -> DataFrame:
    """`entries` with the bytes unpacked up to and with each entry, and whether they pass the limit there; over more buckets a large archive is many tasks."""
    upto = running(entries, ["archive"], F.col("entry"), [], {"upto": ("sum", F.greatest("size", F.lit(0)))}, buckets)
    return upto.withColumn("beyond", F.col("upto") > MOST_BYTES)


def decided(entries: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with the action that is taken, and the decisions (archive, entry, action) that can't be followed, with why.

    Without a decision a redactable entry is redacted and any other left out."""
    e = inspected(entries).where(~F.col("directory"))
    own = decisions.select("archive", "entry", F.col("action").alias("asked"))
    both = e.join(own, ["archive", "entry"], "full")
    wrong = (
        F.when(F.col("path").isNull(), "unknown entry")
        .when(~F.col("asked").isin(*ACTIONS), "unknown action")
        .when(F.col("by_default") & (F.col("asked") == "KEEP_UNPROCESSED"), "can be redacted or left out only")
        .when(~F.col("by_default") & (F.col("asked") == "REDACT"), "can't be redacted")
        .when((F.col("asked") == "KEEP_UNPROCESSED") & ~F.col("may_keep"), "can't be kept as it is")
    )
    both = both.withColumn("wrong", F.when(F.col("asked").isNotNull(), wrong))
    action = F.coalesce("asked", F.when(F.col("by_default"), "REDACT").otherwise("EXCLUDE"))
    good = both.where("path IS NOT NULL AND wrong IS NULL").withColumn("action", action).drop("asked", "wrong")
    return good, both.where("wrong IS NOT NULL").select("archive", "entry", "asked", "wrong")


def manifest(files: DataFrame) -> DataFrame:
    """A row for each archive of decided files (archive, entry, path, action, and optionally failed): counts of what was
    done, and the manifest as JSON, its items in order of their entries. The items of one archive are 10,000 at most."""
    failed = F.col("failed") if "failed" in files.columns else F.lit(False)
    done = F.when(failed, "failed").when(F.col("action") == "REDACT", "redacted").when(F.col("action") == "EXCLUDE", "excluded").otherwise("included_unprocessed")
    items = files.withColumn("done", done)
    kinds = ("redacted", "excluded", "included_unprocessed", "failed")
    item = F.struct("entry", "path", F.col("done").alias("action"))
    got = items.groupBy("archive").agg(*(F.count_if(F.col("done") == k).alias(k) for k in kinds), F.array_sort(F.collect_list(item)).alias("items"))
    return got.withColumn("manifest", F.to_json(F.struct(F.lit(2).alias("version"), *kinds, "items"))).drop("items")
