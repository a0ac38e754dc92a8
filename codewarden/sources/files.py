"""Files tables: from a table or from text at hand; ``tree.py`` reads and writes folder trees."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.config import MANDATORY_EXCLUDES, ScanConfig
from codewarden.functions.paths import excluded, is_inside, resolve_against, scannable
from codewarden.functions.text import lines_of

# Fixed values of the two listings.
LISTED_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "cs", "rb", "php", "cpp", "c", "h", "sh",
                     "sql", "vue", "svelte", "kt", "swift")
LISTED_EXCLUDES = ("node_modules", ".git", "dist", "build", "out", ".next", "coverage")
TREE_SKIPPED = ("node_modules", ".git", "dist", "out", "coverage", ".vscode")
DEFAULT_PATH = "selection.ts"


def collected(config: ScanConfig = ScanConfig()) -> Column:
    """The predicate of a project scan over ``file_path`` and ``size_bytes``."""
    excludes = list(dict.fromkeys([*MANDATORY_EXCLUDES, *config.exclude_patterns]))
    path = F.col("file_path")
    out = scannable(path) & ~excluded(path, excludes)
    return out if config.max_file_size_kb is None else out & (F.col("size_bytes") <= config.max_file_size_kb * 1024)


def discover(paths: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The rows of a ``file_path, size_bytes, ...`` table that a project scan reads."""
    return paths.filter(collected(config))


def too_large(paths: DataFrame, config: ScanConfig) -> DataFrame:
    """What a size limit leaves out: one row with the number of files and their bytes."""
    unlimited = replace(config, max_file_size_kb=None)
    left = paths.filter(collected(unlimited) & ~collected(config))
    return left.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def of_projects(files: DataFrame) -> DataFrame:
    """Files of many projects as one files table: ``project`` becomes the first part of the path.

    A path is the key of a file in findings, scores, policies, fixes and
    replies, so files of the same name in different projects stay apart.
    """
    return files.withColumn("file_path", F.concat_ws("/", F.regexp_replace("project", "/", "%2F"), "file_path")).drop("project")


def repeated_paths(files: DataFrame) -> DataFrame:
    """Paths that occur more than once, with their number; a files table must have none."""
    return files.groupBy("file_path").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def from_text(spark: SparkSession, code: str, file_path: str = DEFAULT_PATH) -> DataFrame:
    """A one-row files table for text at hand."""
    return spark.createDataFrame([(file_path, code, len(code.encode()))],
                                 "file_path string, code string, size_bytes long")


def one_file(files: DataFrame, file_path: str) -> DataFrame:
    return files.filter(F.col("file_path") == file_path)


def file_exists(files: DataFrame, wanted: DataFrame, root: str = "/workspace") -> DataFrame:
    """``wanted(file_path)`` with whether a file or folder of that path exists inside ``root``.

    Paths are resolved first, so ``a/../b`` is ``b``; what leads out of the root does not exist.
    """
    parts = F.split("file_path", "/")
    inside = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = files.select(F.explode(inside).alias("_known")).distinct().withColumn("exists", F.lit(True))
    absolute = resolve_against(F.lit(root), F.col("file_path"))
    relative = F.when(is_inside(F.lit(root), absolute), F.substr(absolute, F.lit(len(root) + 2)))
    asked = wanted.withColumn("_known", relative)
    found = F.coalesce("exists", F.coalesce(F.col("_known") == "", F.lit(False)))
    return asked.join(known, "_known", "left").withColumn("exists", found).drop("_known")


def region(files: DataFrame, start: int, end: int) -> DataFrame:
    """Files cut down to the lines ``start``..``end``; the whole file if that is no range."""
    if not (start and end and end >= start):
        return files
    cut = F.array_join(F.slice(lines_of(F.col("code")), start, end - start + 1), "\n")
    return files.withColumn("code", cut)


def preview(files: DataFrame, start: int = 1, count: int | None = None) -> DataFrame:
    """The lines of each file from ``start`` on, numbered, with the total; ``count`` of them if one is given."""
    lines = lines_of(F.col("code"))
    return files.select(
        "file_path", F.size(lines).alias("total"),
        F.posexplode(F.slice(lines, F.lit(start), F.size(lines) if count is None else F.lit(count))).alias("pos", "text"),
    ).select("file_path", (F.col("pos") + start).alias("n"), "text", "total")


def list_files(paths: DataFrame, query: str = "") -> DataFrame:
    """The file picker: source files whose path holds the text, by path."""
    path = F.col("file_path")
    ext = F.regexp_extract(path, r"\.([^./]+)\z", 1)
    parts = F.split(path, "/")
    skipped = F.exists(parts, lambda p: p.isin(*LISTED_EXCLUDES))
    wanted = ext.isin(*LISTED_EXTENSIONS) & ~skipped & F.contains(F.lower(path), F.lit(query.lower()))
    return (paths.filter(wanted)
            .select("file_path", F.regexp_extract(path, r"([^/]*)\z", 1).alias("name"), ext.alias("ext"))
            .orderBy("file_path"))


def list_tree(paths: DataFrame, folder: str = "", max_depth: int | None = None) -> DataFrame:
    """Paths below ``folder``, of at most ``max_depth`` levels if given, without skipped and dot names."""
    prefix = folder.strip("/")
    below = paths if prefix in ("", ".") else paths.filter(F.col("file_path").startswith(prefix + "/"))
    depth_of = len(prefix.split("/")) if prefix not in ("", ".") else 0
    parts = F.split("file_path", "/")
    inner = F.slice(parts, depth_of + 1, F.size(parts))
    hidden = F.exists(inner, lambda p: p.isin(*TREE_SKIPPED) | p.startswith("."))
    near = F.lit(True) if max_depth is None else F.size(inner) <= max_depth
    return below.filter(near & ~hidden).select("file_path")


def confine(paths: DataFrame, root: str) -> DataFrame:
    """``target`` paths resolved against ``root``, with whether they stay inside."""
    absolute = resolve_against(F.lit(root), F.col("target"))
    return paths.withColumn("resolved", F.when(absolute == "", "/").otherwise(absolute)).withColumn(
        "inside", is_inside(F.lit(root), absolute))
