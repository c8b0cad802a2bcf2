"""Reports and checks over found values, review decisions, jobs, archives and media timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.operators.scans import running


def counts_by_rule(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by, "rule_id").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Both have (case_id, rule_id, value). One row: tp, fp, fn, precision, recall; an empty denominator gives 1."""
    e = expected.select("case_id", "rule_id", "value", F.lit(1).alias("e")).distinct()
    a = actual.select("case_id", "rule_id", "value", F.lit(1).alias("a")).distinct()
    got = e.join(a, ["case_id", "rule_id", "value"], "full").agg(
        F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn")
    )
    share = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(1.0))
    return got.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))


def consolidated(findings: DataFrame, keys: list[str], gap: int = 800, buckets: int = 1) -> DataFrame:
    """Joins spans (start_ms, end_ms) of equal keys that lie at most `gap` apart. Over one bucket a key is one task's window; over more it is spread (see `scans`)."""
    reach = running(findings, keys, F.col("start_ms"), ["end_ms"], {"_reach": ("max_before", F.col("end_ms"))}, buckets)
    new = F.when(F.col("start_ms") - F.col("_reach") <= gap, 0).otherwise(1)
    marked = running(reach, keys, F.col("start_ms"), ["end_ms", "_reach"], {"_island": ("sum", new)}, buckets)
    return marked.groupBy(*keys, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")).drop("_island")


def status_changes(events: DataFrame, job: str, at: str, order: str, status: str, buckets: int = 1) -> DataFrame:
    """The events at which a job's status differs from the one before. With more than one bucket, hot jobs are spread; `at` is a time or a number then."""
    if buckets < 2:
        w = Window.partitionBy(job).orderBy(at, order)
        rows = events.withColumn("previous", F.lag(status).over(w))
    else:
        time = F.unix_micros(F.col(at).cast("timestamp")) if dict(events.dtypes)[at].startswith("timestamp") else F.col(at)
        rows = running(events, [job], time, [order], {"previous": ("previous", F.col(status))}, buckets)
    return rows.where(~F.col("previous").eqNullSafe(F.col(status)))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key: that with the greatest `order` (an upsert's result). Keys are reduced before the shuffle."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns if c != key)), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*").select(*rows.columns)


def project_report(jobs: DataFrame) -> DataFrame:
    """Jobs (project_id, status, size, matches, unprocessed) by project."""
    s = F.col("status")
    return jobs.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(s == "COMPLETED").alias("completed"),
        F.count_if(s.isin("FAILED", "INTERRUPTED")).alias("failed"),
        F.count_if(s == "CANCELLED").alias("cancelled"),
        F.count_if(~s.isin("COMPLETED", "FAILED", "INTERRUPTED", "CANCELLED")).alias("pending"),
        F.sum("size").alias("bytes"),
        F.sum("matches").alias("matches"),
        F.bool_or("unprocessed").alias("any_unprocessed"),
    )


# The file types of each archive category, in the order in which they are tried, and why an entry is in one.
CATEGORIES = (
    ("DANGEROUS", ("exe", "dll", "com", "scr", "msi", "bat", "cmd", "ps1", "vbs", "vbe", "js", "jse", "wsf", "wsh", "hta", "jar", "app", "dmg", "pkg", "sh", "bash", "zsh", "so", "dylib")),
    ("REDACTABLE", ("docx", "xlsx", "pptx", "pdf", "ofd", "png", "jpg", "jpeg", "bmp", "mp3", "wav", "m4a", "flac", "mp4", "mov", "mkv")),
    ("CONVERTIBLE", ("doc", "xls", "ppt", "wps", "dps", "et", "rtf")),
    ("PREVIEW_ONLY", ("gif", "tif", "tiff", "webp", "avi", "flv", "wmv")),
    ("NESTED_ARCHIVE", ("zip", "7z", "tar", "gz", "tgz", "rar")),
)
REASONS = {
    "REDACTABLE": "可使用当前格式处理器脱敏",
    "CONVERTIBLE": "旧版Office/WPS格式需本地转换器，当前不自动转换",
    "PREVIEW_ONLY": "已识别格式，但当前阶段尚未提供安全脱敏处理或安全重封装",
    "NESTED_ARCHIVE": "嵌套压缩包默认不递归展开",
    "UNSUPPORTED": "当前不支持该文件格式",
    "DANGEROUS": "可执行或脚本类高风险文件，始终排除",
    "UNKNOWN": "无法根据文件名识别格式",
}


def archive_reason(category: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv)), category)


def safe_path(path: Column) -> Column:
    """A relative path without drive or NUL that, with its steps resolved, stays inside and has no reserved device names and
    no part with a trailing dot or space."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))

    def step(done: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != "..")
        return F.when((x == "") | (x == "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    parts = F.aggregate(F.split(clean, "/"), F.array().cast("array<string>"), step)
    # Device names.
    device = r"(?i)^(CON|PRN|AUX|NUL|CLOCK\$|COM[1-9]|LPT[1-9])(\..*)?$"
    bad = lambda x: x.rlike(r"[. ]$") | x.rlike(device)
    return F.coalesce((F.trim(path) != "") & ~clean.rlike(r"^/|:|\x00") & ~F.exists(parts, bad), F.lit(False))


def archive_category(path: Column, directory: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.when(directory, "UNSUPPORTED").when(~safe_path(path), "DANGEROUS")
    for name, kinds in CATEGORIES:
        out = out.when(ext.isin(*kinds), name)
    return out.when(ext == "", "UNKNOWN").otherwise("UNSUPPORTED")


def spoken_digits(text: Column) -> Column:
    """Spelled digits as digits, with what separates them dropped."""
    # Digit words.
    for word, digit in (("zero", "0"), ("oh", "0"), ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("six", "6"), ("seven", "7"), ("eight", "8"), ("nine", "9")):
        text = F.regexp_replace(text, rf"(?i)\b{word}\b", digit)
    text = F.translate(text, "零〇一二两三四五六七八九", "001223456789")
    # What may stand between digits.
    return F.regexp_replace(text, r"(?<=[0-9])[\s,，.。·-]+(?=[0-9])", "")


def unique_names(names: DataFrame, name: str, order: str) -> DataFrame:
    """Names that clash, whatever their case, get ` (2)`, ` (3)` and so on before the extension."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return names.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext))).drop("_n")


def merged_counts(reports: DataFrame, *by: str, order: str | None = None) -> DataFrame:
    """Reports of parts (by, units, counts: a map from rule to number, warnings) as one: rules' numbers are added, each
    warning is kept once, where it first appears by the column `order` (without one: by its text)."""
    rows = reports.select(*by, F.explode_outer("counts").alias("rule_id", "n"))
    rules = rows.where("n IS NOT NULL").groupBy(*by, "rule_id").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("counts"))
    place = F.struct(F.col(order), F.col("_i")) if order else F.struct(F.col("_w"))
    said = reports.select(*by, *([order] if order else []), F.posexplode("warnings").alias("_i", "_w")).where(F.trim("_w") != "")
    kept = said.groupBy(*by, "_w").agg(F.min(place).alias("_p")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_w"))), lambda x: x["_w"]).alias("warnings"))  # each warning once
    rest = reports.groupBy(*by).agg(F.sum("units").alias("units")).join(kept, list(by), "left")
    return rest.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>"))).join(rules, list(by), "left")


def saturated_sum(value: Column) -> Column:
    """The sum of longs that stops at the greatest long instead of overflowing."""
    return F.least(F.sum(value.cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def saturated_total(value: Column) -> Column:
    """The sum of a job's counts, which stops at the greatest int."""
    return F.least(F.sum(value.cast("decimal(38,0)")), F.lit(2**31 - 1).cast("decimal(38,0)")).cast("int")


def newest(jobs: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The `most` newest jobs, by falling time and then falling key."""
    return jobs.orderBy(F.col(at).desc(), F.col(key).desc()).limit(most)


def oldest_first(jobs: DataFrame, at: str, key: str) -> DataFrame:
    """Jobs in the order in which they are taken up again: by time, then key."""
    return jobs.orderBy(at, key)


# The states of a job, those that are at work, those that are final, and which follow which.
STATES = ("UPLOADED", "INSPECTING", "AWAITING_CONFIRMATION", "ANALYZING", "AWAITING_REVIEW", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED", "INTERRUPTED")
ACTIVE = ("UPLOADED", "INSPECTING", "ANALYZING", "PROCESSING")
FINISHED = ("COMPLETED", "FAILED", "CANCELLED")
EDGES = (
    ("UPLOADED", "INSPECTING"), ("UPLOADED", "ANALYZING"), ("UPLOADED", "PROCESSING"), ("UPLOADED", "FAILED"), ("INSPECTING", "AWAITING_CONFIRMATION"), ("INSPECTING", "FAILED"),
    ("ANALYZING", "AWAITING_REVIEW"), ("ANALYZING", "FAILED"), ("AWAITING_CONFIRMATION", "PROCESSING"), ("AWAITING_REVIEW", "PROCESSING"),
    ("PROCESSING", "COMPLETED"), ("PROCESSING", "FAILED"), ("PROCESSING", "ANALYZING"), ("INTERRUPTED", "UPLOADED"),
    *((s, "INTERRUPTED") for s in ACTIVE), *((s, "CANCELLED") for s in STATES if s not in (*FINISHED, "INTERRUPTED")),
)


def edges(spark: SparkSession) -> DataFrame:
    """The legal changes of a job's state: previous, status."""
    return spark.createDataFrame(list(EDGES), "previous string, status string")


def illegal_changes(changes: DataFrame, status: str, previous: str = "previous") -> DataFrame:
    """Changes that no edge of the state machine allows. A job's first state (no previous one) must be UPLOADED; a state that is said again is no change. A null or unknown state is never legal."""
    legal = F.broadcast(edges(changes.sparkSession).select(F.col("previous").alias("_from"), F.col("status").alias("_to")))  # some thirty rows
    real = changes.where(~F.col(status).eqNullSafe(F.col(previous)) & ~(F.col(previous).isNull() & F.col(status).eqNullSafe(F.lit(STATES[0]))))
    return real.join(legal, (F.col(previous) == F.col("_from")) & (F.col(status) == F.col("_to")), "left_anti")


def kept_originals(found: DataFrame, redacted: DataFrame, key: str = "doc_id", text: str = "redacted") -> DataFrame:
    """The distinct original values (key, value) that still stand in the rewritten text of their row."""
    values = found.select(key, "value").distinct()
    rows = redacted.select(key, text)
    return values.join(rows, key).where(F.col(text).contains(F.col("value"))).select(key, "value").distinct()


def safe_message(text: Column, most: int = 200) -> Column:
    """A message on one line of at most `most` characters; null if there is nothing in it."""
    line = F.trim(F.regexp_replace(text, r"[\r\n\t]+", " "))
    return F.when(line != "", F.substring(line, 1, most))


def html_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def clock(millis: Column) -> Column:
    """Milliseconds as hh:mm:ss.SSS."""
    s = F.floor(millis / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, millis % 1000)


def valid_key(text: Column) -> Column:
    """Whether a project's or job's key is of 1 to 80 letters, digits, dots, dashes and underscores."""
    return F.coalesce(text.rlike(r"^[A-Za-z0-9._-]{1,80}$"), F.lit(False))
