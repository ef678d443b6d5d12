"""Which files of a corpus are sources, their hashes, and audits of archives, URLs and paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import scalars as s
from codecorpus.shipping import ship

# -- fixed values --------------------------------------------------------------------------------------------------
IGNORED_FOLDERS = (".git", "node_modules", "vendor", "dist", "build", "coverage", "__pycache__", ".pytest_cache", ".mypy_cache", ".venv", "venv", "target")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "pipfile.lock", "poetry.lock", "cargo.lock")
MAX_UNCOMPRESSED, MAX_FILE, MAX_ENTRIES, MAX_RATIO, MAX_LINES = 500 * 1024 * 1024, 50 * 1024 * 1024, 10_000, 100.0, 100_000
REPOSITORY = r"^https://github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+?)(?:\.git)?$"
#: What ends a line.
BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
# ------------------------------------------------------------------------------------------------------------------


def is_source_path(path: Column) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.lower(F.element_at(parts, -1))
    ignored = F.exists(folders, lambda p: F.lower(p).isin(*IGNORED_FOLDERS) | F.startswith(p, F.lit(".")))
    return ~ignored & ~name.isin(*LOCK_FILES) & ~F.endswith(name, F.lit(".map"))


def filter_source_paths(df: DataFrame, path: str = "relative_path") -> DataFrame:
    return df.where(is_source_path(F.col(path)))


def filter_max_size(df: DataFrame, size: str = "size_bytes", most: int = MAX_FILE) -> DataFrame:
    return df.where(F.col(size) <= most)


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 1024), F.unhex(F.lit("00")))


def decode_text(content: Column) -> Column:
    """UTF-8; bytes that aren't become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def line_count(text: Column) -> Column:
    ends = F.regexp_count(text, F.lit(BREAKS))
    open_end = (F.length(text) > 0) & ~F.rlike(text, F.lit(f"(?:{BREAKS})\\z"))
    return (ends + open_end.cast("int")).cast("int")


def is_minified(name: Column, first_line: Column, mean_length: Column) -> Column:
    low = F.lower(name)
    named = F.contains(low, F.lit(".min."))
    for end in ("-min.js", "-min.cjs", "-min.mjs"):
        named = named | F.endswith(low, F.lit(end))
    return named | (mean_length > 500) | (F.length(first_line) > 1000)


def hash_files(df: DataFrame, path: str = "relative_path", content: str = "content") -> DataFrame:
    hashed = df.withColumn("sha256_hash", F.sha2(F.col(content).cast("binary"), 256))
    return hashed.withColumn("entry_hash", F.sha2(F.concat_ws(":", F.col(path), F.col("sha256_hash")), 256))


def content_hashes(files: DataFrame, project: str = "project_id", path: str = "relative_path") -> DataFrame:
    """project, content_hash: SHA-256 of the entry hashes in path order, one after the other.

    A digest is sequential, so a project's sorted hashes are one task's stream; the task holds none of them."""
    ship(files.sparkSession)
    kind = files.schema[project].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, types = None, None, None
        for batch in batches:
            names, digests = [], []
            types = batch.schema.field(0).type
            for name, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or name != own:
                    if digest is not None:
                        names.append(own)
                        digests.append(digest.hexdigest())
                    own, digest = name, hashlib.sha256()
                digest.update((entry or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, types), pa.array(digests, pa.string())], ["_project", "content_hash"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], types), pa.array([digest.hexdigest()], pa.string())], ["_project", "content_hash"])

    in_order = files.select(F.col(project).alias("_project"), F.col(path).alias("_path"), "entry_hash").repartition("_project").sortWithinPartitions("_project", "_path", "entry_hash")
    return in_order.select("_project", "entry_hash").mapInArrow(run, f"_project {kind}, content_hash string").withColumnRenamed("_project", project)


def project_rollup(files: DataFrame, project: str = "project_id", path: str = "relative_path", language: str = "language", lines: str = "line_count") -> DataFrame:
    """Files, lines, languages and a content hash of each project; the hash takes entry hashes in path order."""
    counts = files.groupBy(project).agg(F.count(F.lit(1)).alias("total_files"), F.sum(lines).alias("total_lines"), F.array_sort(F.collect_set(language)).alias("detected_languages"))
    hashes = content_hashes(files, project, path).withColumnRenamed(project, "_project")
    return counts.join(hashes, counts[project].eqNullSafe(hashes["_project"])).drop("_project")


def project_limits(projects: DataFrame, rollup: DataFrame, project: str = "project_id", max_lines: int = MAX_LINES) -> DataFrame:
    """Adds status: OK, EXCEEDED_LINE_LIMIT or NO_SOURCE_FILES."""
    joined = projects.join(rollup, project, "left")
    status = F.when(F.coalesce("total_files", F.lit(0)) == 0, "NO_SOURCE_FILES").when(F.col("total_lines") > max_lines, "EXCEEDED_LINE_LIMIT").otherwise("OK")
    return joined.withColumn("status", status)


def escapes(path: Column) -> Column:
    """Whether a path, with / between its parts, ends outside the folder that it starts in."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # parts that no later .. takes back; what is left of the .. themselves leads outside
    outside = F.aggregate(parts, F.struct(F.lit(0).alias("up"), F.lit(0).alias("down")), lambda a, p: F.struct((a["up"] + F.when((p == "..") & (a["down"] == 0), 1).otherwise(0)).alias("up"), F.greatest(F.lit(0), a["down"] + F.when(p == "..", -1).otherwise(1)).alias("down")))
    return outside["up"] > 0


def audit_archive_manifest(entries: DataFrame, archive: str = "archive_id", max_entries: int = MAX_ENTRIES, max_total: int = MAX_UNCOMPRESSED, max_file: int = MAX_FILE) -> DataFrame:
    """The first violated rule of each archive in entry order, or OK; too many entries count before all entries, so only
    archives of at most max_entries are put in order."""
    counts = entries.groupBy(archive).agg(F.count(F.lit(1)).alias("entries"))
    running = F.sum("file_size").over(Window.partitionBy(archive).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    name, mode = F.col("filename"), F.col("external_attr").bitwiseAND(F.lit(0o170000 << 16))
    folder = F.endswith(name, F.lit("/"))
    kinds = [F.lit(k << 16) for k in (0o100000, 0o040000)]
    code = (
        F.when(F.col("flag_bits").bitwiseAND(1) == 1, "ENCRYPTED_ZIP")
        .when(~folder & (F.col("file_size") > max_file), "FILE_TOO_LARGE")
        .when(mode == 0o120000 << 16, "SYMLINK_NOT_ALLOWED")
        .when((mode != 0) & ~mode.isin(*kinds), "UNSUPPORTED_ENTRY_TYPE")
        .when(F.col("_running") > max_total, "EXCESSIVE_UNCOMPRESSED_SIZE")
        .when((F.col("compress_size") > 0) & (F.col("file_size") / F.col("compress_size") > MAX_RATIO) & (F.col("file_size") > 1 << 20), "EXCESSIVE_COMPRESSION_RATIO")
        .when(F.contains(name, F.lit("\0")) | F.contains(name, F.lit(":")) | F.startswith(name, F.lit("/")) | F.startswith(name, F.lit("\\")) | escapes(F.translate(name, "\\", "/")), "PATH_TRAVERSAL")
    )
    own = entries.join(counts.where(F.col("entries") <= max_entries).select(archive), archive, "left_semi")
    found = own.withColumn("_running", running).select(archive, "seq", code.alias("_code"))
    first = found.groupBy(archive).agg(F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col("seq"))).alias("_first"))
    return counts.join(first, archive, "left").select(archive, "entries", F.when(F.col("entries") > max_entries, "EXCESSIVE_ENTRIES").otherwise(F.coalesce("_first", F.lit("OK"))).alias("code"))


def validate_repo_url(url: Column) -> Column:
    """struct(url, error): https://github.com/owner/repo.git, or why not."""
    u = F.trim(url)
    authority = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    error = (
        F.when(url.isNull() | (url == ""), "EMPTY")
        .when(F.contains(u, F.lit("?")) | F.contains(u, F.lit("#")), "QUERY_OR_FRAGMENT")
        .when(~F.rlike(F.lower(u), F.lit("^https:")), "NOT_HTTPS")
        .when(F.contains(authority, F.lit("@")), "CREDENTIALS")
        .when(F.lower(F.regexp_replace(authority, r":\d*$", "")) != "github.com", "OTHER_HOST")
        .when(~F.rlike(u, F.lit(REPOSITORY)), "BAD_FORMAT")
    )
    clean = F.concat(F.lit("https://github.com/"), F.regexp_extract(u, REPOSITORY, 1), F.lit("/"), F.regexp_extract(u, REPOSITORY, 2), F.lit(".git"))
    return F.struct(F.when(error.isNull(), clean).alias("url"), error.alias("error"))


def repo_display_name(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.rtrim(url, F.lit("/")), r"\.git$", ""), "/"), -1)


def tree_size(df: DataFrame, project: str = "project_id", size: str = "size_bytes", most: int = MAX_UNCOMPRESSED) -> DataFrame:
    return df.groupBy(project).agg(F.sum(size).alias("bytes")).withColumn("too_large", F.col("bytes") > most)


def guard_paths(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """Adds safe; unsafe rows stay, as failed modules."""
    p = F.translate(F.col(path), "\\", "/")
    return df.withColumn("safe", ~(F.startswith(p, F.lit("/")) | escapes(p) | F.contains(s.normalize_path(p), F.lit(".."))))


def classified(files: DataFrame, path: str = "relative_path") -> DataFrame:
    return files.withColumn("language", s.classify_language(F.col(path)))
