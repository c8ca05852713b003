"""Source trees as tables: scans, inventories, fingerprints and incremental changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders that a scan passes over, besides hidden ones.
IGNORED = ("build", "coverage", "dist", "node_modules", "out", "target", "vendor")
LARGEST = 1_000_000
#: Languages by extension; those without a parser are listed only.
LANGUAGES = {
    "cjs": "javascript", "js": "javascript", "mjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "py": "python", "php": "php", "java": "java", "rs": "rust", "go": "go", "cs": "csharp", "svelte": "svelte",
    "asm": "assembly", "astro": "astro", "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "headers", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "scala": "scala", "bash": "shell", "sh": "shell", "zsh": "shell", "swift": "swift", "vue": "vue",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(path.rlike("(^|/)Makefile$"), "makefile").otherwise(F.try_element_at(names, extension(path)))


def listed(path: Column, size: Column) -> Column:
    """Whether a scan takes a file: no ignored or hidden folder on its path, a registered extension, not too large."""
    folders = F.split(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), "/")
    hidden = F.exists(folders, lambda f: f.isin(*IGNORED) | f.startswith("."))
    return ~hidden & language(path).isNotNull() & (size <= LARGEST)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, mtime, language, text, source_hash)`` of the source files below a folder; line ends are made ``\\n`` before hashing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), F.lit("^.*?" + _literal(root.rstrip("/") + "/")), F.lit(""))
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content").where(listed(F.col("path"), F.col("size")))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return rows.select("path", "size", "mtime", language(F.col("path")).alias("language"), text.alias("text"), F.sha2(text, 256).alias("source_hash"))


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r".+*?()[]{}^$|\\" else c for c in text.split("://")[-1])


def discover(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """``(language, files, bytes, decision)`` and a row of totals (language null) whose decision holds against the bounds."""
    counts = files.groupingSets([["language"], []], "language").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.grouping("language").alias("g"))
    decision = F.when(F.col("files") > most_files, "file-limit-exceeded").when(F.col("bytes") > most_bytes, "byte-limit-exceeded").otherwise("within-bounds")
    return counts.select("language", "files", "bytes", F.when(F.col("g") == 1, decision).alias("decision"))


def fingerprint(files: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a fingerprint of distinct rows that depends on no order, from partial aggregates."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("long")
    return files.select(h.alias("h")).distinct().agg(F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"), F.count("*").alias("n"))


def verify_plan(planned: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, reason)``: what differs between a planned inventory and the present one; no row means that the plan holds."""
    p = planned.select("path", F.col("size").alias("ps"), F.col("mtime").alias("pm"))
    n = now.select("path", F.col("size").alias("ns"), F.col("mtime").alias("nm"))
    reason = F.when(F.col("ps").isNull(), "source-added").when(F.col("ns").isNull(), "source-removed").when((F.col("ps") != F.col("ns")) | (F.col("pm") != F.col("nm")), "source-changed")
    return p.join(n, "path", "full").select("path", reason.alias("reason")).where("reason is not null")


def subtree(files: DataFrame, prefix: str) -> DataFrame:
    """Files below a folder; the prefix is pushed to the scan where files are a table."""
    return files.where(F.col("path").startswith(prefix.rstrip("/") + "/"))


def incremental(known: DataFrame, now: DataFrame) -> DataFrame:
    """Facts after a change: ``known`` rows of unchanged files, and rows of ``now`` for the others, with ``reparsed``."""
    same = known.select("path", "size", "mtime").join(now.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")
    kept = known.join(same.select("path"), "path", "left_semi").withColumn("reparsed", F.lit(False))
    return kept.unionByName(now.join(same.select("path"), "path", "left_anti").withColumn("reparsed", F.lit(True)))


def history(commits: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """The newest commits of each path with ``truncated``: one more than asked for is looked at."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("time"), "commit"))
    ranked = commits.join(paths.select("path").distinct(), "path", "left_semi").withColumn("rank", rank).where(F.col("rank") <= most + 1)
    more = F.max("rank").over(Window.partitionBy("path")) > most
    return ranked.withColumn("truncated", more).where(F.col("rank") <= most)


def coverage(files: DataFrame) -> DataFrame:
    """Files and parse results by language, with a row of totals."""
    has = lambda p: F.count_if(F.col("status").startswith(p))
    return files.groupingSets([["language"], []], "language").agg(F.count("*").alias("files"), has("parsed").alias("parsed"), F.count_if(F.col("status") == "parsed-with-diagnostics").alias("diagnostics"), has("inventory").alias("inventory"), has("parse-failed").alias("failed"))
