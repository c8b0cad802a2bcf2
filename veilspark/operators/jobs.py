"""Jobs: stored states, room for new ones, selections of a project, and files against a list of what they should be."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.reports import valid_key

# The folders of a job in which its files lie, and whether a state must name one.
FOLDERS = (("inputPath", "original", True), ("outputPath", "output", False), ("vaultPath", "vault", False))
STATES = ("UPLOADED", "INSPECTING", "AWAITING_CONFIRMATION", "ANALYZING", "AWAITING_REVIEW", "PROCESSING", "COMPLETED", "INTERRUPTED", "CANCELLED", "FAILED")


def properties(text: Column) -> Column:
    """The `key=value` lines of a properties file as a map; the last of equal keys counts, comments are left out."""
    lines = F.filter(F.split(F.regexp_replace(text, r"\\\r?\n[ \t]*", ""), r"\r?\n"), lambda x: x.rlike(r"^\s*[^#!\s]"))

    def plain(x: Column) -> Column:
        for sign, made in (("t", "\t"), ("n", "\n"), ("r", "\r")):
            x = F.regexp_replace(x, rf"(?<!\\)((?:\\\\)*)\\{sign}", "$1" + made)
        return F.regexp_replace(x, r"\\(.)", "$1")

    pattern = r"^\s*((?:\\.|[^\\=:\s])+)(?:\s*[=:]\s*|\s+|$)(.*)$"
    pairs = F.transform(lines, lambda x: F.struct(plain(F.regexp_extract(x, pattern, 1)).alias("key"), plain(F.regexp_extract(x, pattern, 2)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def _inside(path: Column, folder: Column) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return clean.startswith(F.concat(folder, F.lit("/"))) & (F.length(clean) > F.length(folder) + 1) & ~clean.rlike(r"(^|/)\.\.?(/|$)")


def job_states(df: DataFrame, folder: str, text: str, *keys: str) -> DataFrame:
    """Stored job states (the folder of a job, the text of its state): keys, id, status, properties, and corrupt, where the id
    isn't the folder's name, the status is unknown or a path leads out of the job's own folders. Nothing is dropped."""
    p = F.col("properties")
    get = lambda k: F.element_at(p, k)
    rows = df.withColumn("properties", properties(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumns({"id": get("id"), "status": get("status")})
    home = F.regexp_replace(F.replace(F.col(folder), F.lit("\\"), F.lit("/")), "/+$", "")
    named = (F.col("id") == F.regexp_extract(home, "([^/]*)$", 1)) & valid_key(F.col("id")) & F.col("status").isin(*STATES)
    paths = (F.coalesce(_inside(get(k), F.concat(home, F.lit("/" + own))), F.lit(not needed)) for k, own, needed in FOLDERS)
    good = F.coalesce(reduce(and_, paths, named), F.lit(False))
    return rows.select(*keys, "id", "status", "properties", (~good).alias("corrupt"))


def job_history(spark: SparkSession, path: str) -> DataFrame:
    """The states below `path`/<job>/job.properties that aren't corrupt."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "job.properties").option("recursiveFileLookup", True).load(path)
    where = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "/job\\.properties$", "")
    rows = files.select(where.alias("folder"), F.decode("content", "utf-8").alias("text"))
    return job_states(rows, "folder", "text", "folder").where(~F.col("corrupt")).drop("corrupt")


def reservations(asked: DataFrame, used: int, limit: int) -> DataFrame:
    """Requests (owner, bytes) with why each is refused, if each were the next beside those that `held` marks as granted:
    no owner, a negative number, an owner that holds room already, or no room left. One row for each request."""
    granted = asked.where("held").groupBy("owner").agg(F.sum(F.col("bytes").cast("decimal(38,0)")).alias("own"))
    total = granted.agg(F.coalesce(F.sum("own"), F.lit(0).cast("decimal(38,0)")))
    new = asked.where(~F.col("held")).drop("held").join(granted, "owner", "left").withColumn("reserved", total.scalar())
    why = (
        F.when(F.trim(F.coalesce("owner", F.lit(""))) == "", "no owner")
        .when(F.col("bytes").isNull() | (F.col("bytes") < 0), "no valid size")
        .when(F.col("own").isNotNull(), "holds room already")
        .when(F.col("reserved") + F.lit(used) + F.col("bytes") > F.lit(limit), "no room left")
    )
    return new.withColumn("refused", why).drop("own", "reserved")


def selection_problems(selected: DataFrame, jobs: DataFrame) -> DataFrame:
    """Selected (project_id, id) that aren't complete jobs of their project, with why."""
    known = jobs.select("id", F.col("project_id").alias("_project"), "status")
    both = selected.join(known, "id", "left")
    why = F.when(F.col("status").isNull(), "unknown job").when(~F.col("_project").eqNullSafe(F.col("project_id")), "job of another project").when(F.col("status") != "COMPLETED", "not complete")
    return both.withColumn("problem", why).where("problem IS NOT NULL").select("project_id", "id", "problem")


def file_differences(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Files (path, size, sha256) that aren't as they are declared: path and what is wrong."""
    d = declared.select("path", F.struct("size", F.lower("sha256").alias("sha256")).alias("d"))
    a = actual.select("path", F.struct("size", F.lower("sha256").alias("sha256")).alias("a"))
    both = d.join(a, "path", "full")
    why = F.when(F.col("a").isNull(), "missing").when(F.col("d").isNull(), "not declared").when(~F.col("a.size").eqNullSafe(F.col("d.size")), "size").when(~F.col("a.sha256").eqNullSafe(F.col("d.sha256")), "hash")
    return both.withColumn("problem", why).where("problem IS NOT NULL").select("path", "problem")
