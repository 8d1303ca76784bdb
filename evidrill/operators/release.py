"""What a release must not hold: large files, texts that aren't UTF-8, private fragments, secrets, personal paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_rules import SECRETS

# Which files are texts, and traces of a machine that a text may hold.
TEXT_SUFFIXES = (".md", ".py", ".json", ".yaml", ".yml", ".txt", ".toml", ".ini")
FRAGMENTS = ("codex-clipboard-", "AppData/Local/Temp", "AppData\\Local\\Temp")
PERSONAL_PATH = r"(?i)C:\\Users\\(?!example(?:\\|$))[^\\\s]+"


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files below a folder: path (within it), length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = folder.split(":", 1)[-1].rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("path"), "length", "content")


def audit_files(files: DataFrame, fragments: tuple[str, ...] = FRAGMENTS, most_bytes: int = 1_000_000, exempt: tuple[str, ...] = ()) -> DataFrame:
    """files: path, length, content (bytes). A row for each finding: path, rule (large_file, not_utf8, fragment, secret, path)
    and detail. Any file can be large; the others are rules on texts. Files in `exempt` may name fragments, and a
    licence may name paths. One look for all fragments and one for all secrets pass most texts; only of the others is
    asked which it is."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    d = files.withColumn("is_text", suffix.isin(*TEXT_SUFFIXES)).withColumn("valid", F.is_valid_utf8(F.col("content").cast("string")))
    t, low = F.col("t"), F.lower("t")
    d = d.withColumn("t", F.when(F.col("is_text") & F.col("valid"), F.col("content").cast("string")))
    found = lambda rule, when, detail="": F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))
    none = F.array().cast("array<struct<rule:string,detail:string>>")
    any_fragment = low.rlike("|".join(r"\Q" + f.lower() + r"\E" for f in fragments)) if fragments else F.lit(False)
    named = F.when(any_fragment & ~F.col("path").isin(*exempt, ""), F.array(*[found("fragment", low.contains(f.lower()), f) for f in fragments])).otherwise(none)
    any_secret = t.rlike("(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in SECRETS.values()))
    secret = F.when(any_secret, F.array(*[found("secret", t.rlike(p), name) for name, p in SECRETS.items()])).otherwise(none)
    own = F.array(
        found("large_file", F.col("length") > most_bytes, F.col("length").cast("string")), found("not_utf8", F.col("is_text") & ~F.col("valid")),
        found("path", (F.col("path") != "LICENSE") & t.rlike(PERSONAL_PATH)),
    )
    rows = F.array_compact(F.concat(own, F.coalesce(named, none), F.coalesce(secret, none)))
    return d.select("path", F.explode(rows).alias("f")).select("path", "f.rule", "f.detail")
