"""File names, types, capacity and sealed copies."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.detect import detect, rewritten
from veilspark.plans.rules import RuleSet

# The bytes (in hex) that files of a type begin with.
MAGIC = {"pdf": "255044462D", "docx": "504B", "xlsx": "504B", "pptx": "504B", "zip": "504B", "ofd": "504B", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF", "bmp": "424D", "flac": "664C6143", "mkv": "1A45DFA3", "7z": "377ABCAF271C", "gz": "1F8B", "rar": "526172211A07"}
#: How much work space a type needs: a factor and a least number of bytes; last, that of all other types.
WORKSPACE = (
    (("pdf", "ofd"), 6, 2 << 30),
    (("png", "jpg", "jpeg", "bmp"), 4, 512 << 20),
    (("mp4", "mov", "mkv"), 5, 4 << 30),
    (("mp3", "wav", "m4a", "flac"), 4, 2 << 30),
)
OTHER_WORKSPACE = (3, 256 << 20)


def extension(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(r"\.tar\.gz$"), "tar.gz").otherwise(F.regexp_extract(low, r"\.([^./\\]+)$", 1))


def magic_matches(name: Column, content: Column) -> Column:
    """Whether a file's first bytes are those of its extension; null for extensions without a known beginning."""
    out, ext = F.lit(None).cast("boolean"), extension(name)
    for e, head in MAGIC.items():
        out = F.when(ext == e, F.hex(F.substring(content, 1, len(head) // 2)) == head).otherwise(out)
    head = lambda i, n: F.hex(F.substring(content, i, n))
    wave = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57415645")
    mp3 = head(1, 3).isin("494433") | (head(1, 1) == "FF") & (F.hex(F.substring(content, 2, 1)) >= "E0")
    movie = (head(5, 4) == "66747970") & (F.octet_length(content) >= 12)
    tar = F.hex(F.substring(content, 258, 5)) == "7573746172"
    return F.when(ext == "wav", wave).when(ext == "mp3", mp3).when(ext.isin("mp4", "mov", "m4a"), movie).when(ext == "tar", tar).otherwise(out)


def safe_name(name: Column) -> Column:
    """The last part of a path without characters that file systems refuse; `upload` if nothing is left."""
    leaf = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    leaf = F.regexp_replace(F.regexp_replace(leaf, r"""[<>:"|?*\p{Cntrl}]""", "_"), "[. ]+$", "")
    leaf = F.when(F.upper(leaf).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$"), F.concat(F.lit("_"), leaf)).otherwise(leaf)
    return F.when(F.coalesce(leaf, F.lit("")) == "", "upload").otherwise(leaf)


#: Fixed value: what is put behind a redacted file's name.
SUFFIX = "_脱敏"


def redacted_names(df: DataFrame, name: str, rules: RuleSet | None = None, suffix: str = SUFFIX, most: int = 180) -> DataFrame:
    """`df` with `new_name`: found values in the stem replaced, a suffix before the extension, at most `most` code points."""
    ext = extension(F.col(name))
    dotted = F.when(ext == "", "").otherwise(F.concat(F.lit("."), F.right(F.col(name), F.length(ext))))
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(dotted))
    rows = df.withColumn("_stem", stem).withColumn("_dotted", dotted).withColumn("_seen", F.translate("_stem", "_-", "  "))
    rows = detect(rows, rules, "_seen", "_found")
    clean = F.when(F.size("_found") > 0, rewritten(F.col("_stem"), F.col("_found"), lambda v, r: F.lit("REDACTED"))).otherwise(F.col("_stem"))
    kept = F.substring(clean, F.lit(1), F.lit(most - len(suffix)) - F.length("_dotted"))
    return rows.withColumn("new_name", F.concat(kept, F.lit(suffix), F.col("_dotted"))).drop("_stem", "_dotted", "_seen", "_found")


def redacted_paths(df: DataFrame, path: str, rules: RuleSet | None = None) -> DataFrame:
    """The distinct paths of `df` (path, new_path): found values in each step replaced, and characters that file systems
    refuse; the extension of the last step stays. Steps are rows while values are found in them."""
    steps = F.posexplode(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")).alias("_at", "_step")
    rows = df.select(path).where(F.col(path).isNotNull()).distinct().select(path, steps, (F.size(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")) - 1).alias("_last"))
    ext = F.when(F.col("_at") == F.col("_last"), extension(F.col("_step"))).otherwise("")
    rows = rows.withColumn("_dotted", F.when(ext == "", "").otherwise(F.concat(F.lit("."), F.right(F.col("_step"), F.length(ext)))))
    rows = rows.withColumn("_stem", F.substring(F.col("_step"), F.lit(1), F.length("_step") - F.length("_dotted")))
    rows = detect(rows.withColumn("_seen", F.translate("_stem", "_-", "  ")), rules, "_seen", "_found")
    clean = F.when(F.size("_found") > 0, rewritten(F.col("_stem"), F.col("_found"), lambda v, r: F.lit("REDACTED"))).otherwise(F.col("_stem"))
    made = F.when(F.trim("_step") == "", F.col("_step")).otherwise(safe_name(F.concat(clean, F.col("_dotted"))))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_at"), made.alias("_new"))))
    return rows.groupBy(path).agg(F.array_join(F.transform(ordered, lambda x: x["_new"]), "/").alias("new_path"))


def capacity(files: DataFrame, name: str, size: str, reversible: bool = False) -> DataFrame:
    """One row for files: their bytes, what stays on disk, the largest work space, and the peak of both."""
    ext, (factor, least) = extension(F.col(name)), OTHER_WORKSPACE
    work = F.greatest(F.col(size) * factor, F.lit(least))
    for kinds, factor, least in WORKSPACE:
        work = F.when(ext.isin(*kinds), F.greatest(F.col(size) * factor, F.lit(least))).otherwise(work)
    total = F.coalesce(F.sum(size), F.lit(0))
    stay = total * (2 if reversible else 1)
    space = F.coalesce(F.max(work), F.lit(0))
    return files.agg(F.count(F.lit(1)).alias("files"), total.alias("bytes"), stay.alias("persistent"), space.alias("workspace"), (stay + space).alias("peak"))


def vault_key(passphrase: str, salt: bytes, rounds: int = 600_000) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32)


def sealed(df: DataFrame, content: str, key: bytes, label: str = "veilspark/vault/v1") -> DataFrame:
    """`df` with `content` encrypted by AES-GCM, bound to `label`."""
    return df.withColumn(content, F.aes_encrypt(F.col(content), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.lit(label)))


def opened(df: DataFrame, content: str, key: bytes, label: str = "veilspark/vault/v1") -> DataFrame:
    """The reverse of `sealed`; null where the key, the label or the bytes are wrong."""
    return df.withColumn(content, F.try_aes_decrypt(F.col(content), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(label)))


def new_salt() -> bytes:
    return os.urandom(16)
