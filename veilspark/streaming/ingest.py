"""Files taken in as they appear: lengths and SHA-256 checked against what was declared, each file once.

A stream lists new files; each batch is written to a folder of its own number, and a line in the ledger says that the batch is
whole. A batch that is run again replaces its folder, and readers see only batches in the ledger, so a write that broke off is
as if it had never been. Contents of files above the limit are never read: Spark leaves them out by their length.

Defined cases: a file is refused, with the reason, if it is above the limit, of another length or hash than declared,
without a processor for its extension, or without the beginning that its extension asks for. Nothing need be declared.
Spark lists no empty files: they get no row, and show as missing when the declared files are compared with those taken in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.files import extension, magic_matches

#: Which processor takes an extension; the largest upload.
PROCESSORS = {"docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "pdf": "pdf", "ofd": "ofd"} | dict.fromkeys(("png", "jpg", "jpeg", "bmp"), "image") | dict.fromkeys(("mp4", "mov", "mkv", "mp3", "wav", "m4a", "flac"), "media") | dict.fromkeys(("zip", "tar", "tar.gz", "tgz"), "archive")
LIMIT = 1 << 30
FILES = "path string, modificationTime timestamp, length long, content binary"
SHAPE = "path string, size long, modified timestamp, sha256 string, processor string, refused string"


def processor(name: Column) -> Column:
    """The processor of a file by its name; null if there is none."""
    ext, out = extension(name), F.lit(None).cast("string")
    for kind in dict.fromkeys(PROCESSORS.values()):
        out = F.when(ext.isin(*(e for e, k in PROCESSORS.items() if k == kind)), kind).otherwise(out)
    return out


def checked(files: DataFrame, declared: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """Files (path, length, modificationTime, content) with their hash, processor and reason of refusal: see SHAPE.

    `declared`: path (as it ends), size, sha256; null where nothing was said."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    kept = ("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    small = files.where(F.col("length") <= limit).select(*kept, F.sha2("content", 256).alias("sha256"), F.coalesce(magic_matches(name, F.col("content")), F.lit(True)).alias("fits"))
    large = files.where(F.col("length") > limit).select(*kept, F.lit(None).cast("string").alias("sha256"), F.lit(True).alias("fits"))
    rows = small.unionByName(large).withColumn("_name", F.regexp_extract("path", r"([^/\\]*)$", 1))
    if declared is None:
        rows = rows.withColumn("_size", F.lit(None).cast("long")).withColumn("_sha", F.lit(None).cast("string"))
    else:
        said = declared.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.lower("sha256").alias("_sha")).dropDuplicates(["_path"])
        rows = rows.join(said, F.col("_name") == F.col("_path"), "left")
    refused = (
        F.when(F.col("size") > limit, "above the limit").when(F.col("size") != F.col("_size"), "another length than declared").when(F.col("sha256") != F.col("_sha"), "another hash than declared")
        .when(processor(F.col("_name")).isNull(), "no processor").when(~F.col("fits"), "not what its name says")
    )
    return rows.select("path", "size", "modified", "sha256", processor(F.col("_name")).alias("processor"), refused.alias("refused"))


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, declared: DataFrame | None = None, limit: int = LIMIT, files_a_batch: int = 1000) -> StreamingQuery:
    """Takes in what is new below `source`, and ends."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(source)

    def take(batch: DataFrame, number: int) -> None:
        checked(batch, declared, limit).write.mode("overwrite").parquet(f"{store}/files/batch={number}")
        batch.sparkSession.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{store}/ledger/batch={number}")

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """All files of whole batches: see SHAPE, and batch."""
    whole = spark.read.schema("at timestamp, batch long").parquet(f"{store}/ledger").select("batch").distinct()
    return spark.read.schema(f"{SHAPE}, batch long").parquet(f"{store}/files").join(F.broadcast(whole), "batch", "left_semi")  # a number for each batch
