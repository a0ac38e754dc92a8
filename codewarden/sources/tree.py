"""Folder trees as a data source: ``spark.read.format("code_tree")`` and ``df.write.format("code_tree")``.

Reading.  The driver lists upper folders until it has enough of them to share out; tasks, as many as asked for at most, list
what is below and read the files.  Excluded folders are not entered, and files that fail the scan's tests or a pushed filter on ``file_path`` or
``size_bytes`` are not opened.  Names that begin with a dot or an underscore, which Spark's file sources leave out, are
read like others.  Links are not followed; a folder that cannot be read has no entries, a file that cannot be read has a
null text, and bytes that are not UTF-8 become the replacement character.

Writing.  Tasks write to a staging folder below the root, each under its own attempt, with a list of what belongs where.
Only when all tasks are done are files moved to their places, parents made, and each file replaced as a whole; a failed
job removes its staging folder and changes no file.  The format moves them on the driver, where Spark commits; ``write_tree``
lets a second job do it, whose tasks may be repeated.

The module is pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from codewarden.config import MANDATORY_EXCLUDES, ScanConfig
from codewarden.functions.paths import ALLOWED_HIDDEN, SCANNABLE_BASENAMES, SCANNABLE_EXTENSIONS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "code_tree"
# Folders to share out unless an option says so, bytes of files per task where the driver knows them, characters per batch.
SHARES, TASK_BYTES, BATCH_CHARS = 256, 64 << 20, 8_000_000
MOVES_AT_ONCE = 16
FILES = pa.schema([("file_path", pa.string()), ("code", pa.string()), ("size_bytes", pa.int64())])


def _system(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path).rstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _text(system, path: str) -> str | None:
    try:
        with system.open_input_stream(path) as stream:
            return stream.read().decode("utf-8", errors="replace")
    except OSError:
        return None


def name_test(patterns: Iterable[str]):
    """Whether a path component is excluded or hidden; only ``*`` is a wildcard."""
    globs = [".*".join(re.escape(part) for part in p.split("*")) for p in patterns]
    known = re.compile("|".join(globs) or r"(?!)", re.S)

    def dropped(name: str) -> bool:
        hidden = name.startswith(".") and not name.startswith(".env") and name not in ALLOWED_HIDDEN
        return hidden or bool(known.fullmatch(name))

    return dropped


def is_scannable(rel: str) -> bool:
    base = rel.rsplit("/", 1)[-1]
    found = re.search(r"[^./\\][^/\\]*?(\.[^./\\]*)\Z", base)
    ext = found[1].lower() if found else ""
    return ext in SCANNABLE_EXTENSIONS or (ext == "" and base in SCANNABLE_BASENAMES)


def safe_path(rel: str) -> str:
    """The path without ``.``, ``..`` and doubled slashes; one that leads out of the tree is refused."""
    parts: list[str] = []
    for part in rel.split("/"):
        if part == "..":
            if not parts:
                raise ValueError(f"the path leads out of the tree: {rel}")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    if rel.startswith("/") or not parts:
        raise ValueError(f"no path below the tree: {rel}")
    return "/".join(parts)


# --- filters -------------------------------------------------------------------------

@dataclass
class Test:
    """A filter that the listing can answer."""

    column: str
    kind: str
    value: object
    negated: bool = False

    def holds(self, rel: str, size: int) -> bool:
        x, v = (rel if self.column == "file_path" else size), self.value
        found = {"EqualTo": lambda: x == v, "In": lambda: x in v, "GreaterThan": lambda: x > v, "GreaterThanOrEqual": lambda: x >= v,
                 "LessThan": lambda: x < v, "LessThanOrEqual": lambda: x <= v, "StringStartsWith": lambda: x.startswith(v),
                 "StringEndsWith": lambda: x.endswith(v), "StringContains": lambda: v in x, "IsNotNull": lambda: True}[self.kind]()
        return found != self.negated

    def enters(self, folder: str) -> bool:
        """Whether a file below the folder can pass."""
        if self.column != "file_path" or self.negated or not folder:
            return True
        inside = folder + "/"
        if self.kind == "StringStartsWith":
            return inside.startswith(self.value) or self.value.startswith(inside)
        wanted = {"EqualTo": lambda: (self.value,), "In": lambda: self.value}.get(self.kind)
        return wanted is None or any(w.startswith(inside) for w in wanted())


_PATH_TESTS = ("EqualTo", "In", "StringStartsWith", "StringEndsWith", "StringContains", "IsNotNull")
_SIZE_TESTS = ("EqualTo", "In", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "IsNotNull")


def as_test(filter: ds.Filter) -> Test | None:
    """The test of a filter, or None if Spark has to apply it."""
    negated = isinstance(filter, ds.Not)
    inner = filter.child if negated else filter
    kind, column = type(inner).__name__, getattr(inner, "attribute", ())
    known = {("file_path",): _PATH_TESTS, ("size_bytes",): _SIZE_TESTS}.get(tuple(column), ())
    value = getattr(inner, "value", None)
    if kind not in known or (value is None and kind != "IsNotNull") or (kind == "In" and any(v is None for v in value)):
        return None
    return Test(column[0], kind, tuple(value) if kind == "In" else value, negated)


# --- reading -------------------------------------------------------------------------

@dataclass
class Share(ds.InputPartition):
    """Folders of a task: each with all below it, or part so many of its own files."""

    folders: tuple[tuple[str, bool, int, int], ...]


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.excludes = json.loads(options.get("excludes", "[]"))
        self.max_bytes = int(options["max_bytes"]) if options.get("max_bytes") else None
        self.shares = int(options.get("shares", SHARES))
        self.every = options.get("every_file", "false") == "true"
        self.content = options.get("content", "true") == "true"
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            test = as_test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def _entries(self, system, base: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders and files of a folder that may hold or be what is read."""
        import os

        from pyarrow import fs

        dropped = name_test(self.excludes)
        try:
            infos = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=False))
        except OSError:
            return [], []
        local, folders, files = isinstance(system, fs.LocalFileSystem), [], []
        for i in sorted(infos, key=lambda i: i.base_name):
            rel = f"{folder}/{i.base_name}" if folder else i.base_name
            if (not self.every and dropped(i.base_name)) or (local and os.path.islink(i.path)):
                continue
            if i.type == fs.FileType.Directory:
                if all(t.enters(rel) for t in self.tests):
                    folders.append(rel)
            elif i.type == fs.FileType.File:
                fits = self.every or (is_scannable(rel) and (self.max_bytes is None or i.size <= self.max_bytes))
                if fits and all(t.holds(rel, i.size) for t in self.tests):
                    files.append((rel, i.size))
        return folders, files

    def partitions(self) -> list[Share]:
        """Lists level by level until there are folders enough; of those it has listed it keeps only the bytes."""
        system, base = _system(self.root)
        frontier, own = [""], []
        while frontier and len(frontier) < self.shares:
            level, frontier = frontier, []
            for folder in level:
                folders, files = self._entries(system, base, folder)
                frontier += folders
                if files:
                    own.append((folder, sum(size for _, size in files)))
        # a level may have a folder for each file: they are dealt to so many tasks, not one task to each
        deal = min(len(frontier), self.shares)
        shares, held, size = [Share(tuple((folder, True, 0, 1) for folder in frontier[k::deal])) for k in range(deal)], [], 0
        for folder, bytes_ in own:
            parts = -(-bytes_ // TASK_BYTES) or 1
            if parts > 1:
                shares += [Share(((folder, False, k, parts),)) for k in range(parts)]
                continue
            if held and size + bytes_ > TASK_BYTES:
                shares.append(Share(tuple(held)))
                held, size = [], 0
            held.append((folder, False, 0, 1))
            size += bytes_
        return shares + ([Share(tuple(held))] if held or not shares else [])

    def _files(self, system, base: str, share: Share) -> Iterator[tuple[str, int]]:
        for folder, below, part, parts in share.folders:
            waiting = [folder]
            while waiting:
                folders, files = self._entries(system, base, waiting.pop())
                waiting += folders if below else []
                yield from (f for f in files if parts == 1 or zlib.crc32(f[0].encode("utf-8", "surrogateescape")) % parts == part)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, base = _system(self.root)
        schema, rows, held = FILES if self.content else FILES.remove(1), [], 0
        for rel, size in self._files(system, base, partition):
            row = {"file_path": rel, "size_bytes": size}
            if self.content:
                row["code"] = _text(system, f"{base}/{rel}")
                held += len(row["code"] or "")
            rows.append(row)
            if held >= BATCH_CHARS or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


# --- writing -------------------------------------------------------------------------

@dataclass
class Staged(ds.WriterCommitMessage):
    """The attempt whose list of files counts."""

    attempt: str
    files: int


def _stage(system, folder: str, files: Iterable[tuple[str, str | None]]) -> int:
    """Puts files into a folder, by number, with the list of their places; how many there are."""
    places = []
    for path, code in files:
        if code is None:
            continue  # a file that could not be read stays as it is
        places.append(safe_path(path))
        if len(places) == 1:
            system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{len(places) - 1}") as out:
            out.write(code.encode("utf-8"))
    if places:
        with system.open_output_stream(f"{folder}/list") as out:
            out.write(json.dumps(places).encode())
    return len(places)


def _place(system, folder: str, base: str) -> int:
    """Moves staged files to their places; what an earlier attempt has moved stays."""
    from pyarrow import fs

    made: set[str] = set()

    def move(x: tuple[int, str]) -> None:
        n, rel = x
        parent = f"{base}/{rel}".rsplit("/", 1)[0]
        if parent not in made:
            system.create_dir(parent, recursive=True)
            made.add(parent)
        try:
            system.move(f"{folder}/{n}", f"{base}/{rel}")
        except OSError:
            here, there = (i.type for i in system.get_file_info([f"{folder}/{n}", f"{base}/{rel}"]))
            if here != fs.FileType.NotFound or there != fs.FileType.File:
                raise

    with system.open_input_stream(f"{folder}/list") as listed:
        places = json.loads(listed.read())
    with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
        return len(list(pool.map(move, enumerate(places))))


def _clear(system, folder: str) -> None:
    from pyarrow import fs

    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


class TreeWriter(ds.DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.root, self.stage = options["path"], f".staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        from pyspark import TaskContext

        system, base = _system(self.root)
        attempt = str(TaskContext.get().taskAttemptId())
        return Staged(attempt, _stage(system, f"{base}/{self.stage}/{attempt}", ((r["file_path"], r["code"]) for r in rows)))

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = _system(self.root)
        system.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.files:
                _place(system, f"{base}/{self.stage}/{m.attempt}", base)
        _clear(system, f"{base}/{self.stage}")

    def abort(self, messages: list[Staged | None]) -> None:
        system, base = _system(self.root)
        _clear(system, f"{base}/{self.stage}")


class FileTree(ds.DataSource):
    """Options: ``path``; for reading also ``excludes`` (a JSON list), ``max_bytes``, ``shares``, ``every_file`` (no tests of
    names and types) and ``content`` (false: paths and sizes only, no file is opened)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        code = "code string, " if self.options.get("content", "true") == "true" else ""
        return f"file_path string, {code}size_bytes long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("write with mode append: files are replaced one by one, others stay")
        return TreeWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it."""
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tree(spark: SparkSession, root: str, config: ScanConfig = ScanConfig(), content: bool = True) -> DataFrame:
    """Files of a folder tree, as a project scan sees them; ``root`` must be reachable from every executor."""
    register(spark)
    excludes = list(dict.fromkeys([*MANDATORY_EXCLUDES, *config.exclude_patterns]))
    reader = spark.read.format(FORMAT).option("excludes", json.dumps(excludes)).option("content", str(content).lower())
    if config.max_file_size_kb is not None:
        reader = reader.option("max_bytes", config.max_file_size_kb * 1024)
    return reader.load(root)


def every_file(spark: SparkSession, root: str) -> DataFrame:
    """All files of a folder tree, whatever their names and types."""
    register(spark)
    return spark.read.format(FORMAT).option("every_file", "true").load(root)


def read_paths(paths: DataFrame, root: str) -> DataFrame:
    """The files below ``root`` that ``paths(file_path, size_bytes)`` names; no others are opened, and nothing is listed."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for batch in batches:
            rows, held = [], 0
            for rel, size in zip(batch["file_path"].to_pylist(), batch["size_bytes"].to_pylist()):
                rows.append({"file_path": rel, "code": _text(system, f"{base}/{rel}"), "size_bytes": size})
                held += len(rows[-1]["code"] or "")
                if held >= BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=FILES)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=FILES)

    return paths.select("file_path", "size_bytes").mapInArrow(read, "file_path string, code string, size_bytes long")


def write_tree(files: DataFrame, root: str) -> None:
    """Each row of ``file_path, code`` as a file below ``root``, replaced whole; other files stay.  Paths must not repeat.

    What ``df.write.format`` does, but tasks also move the files: one job stages them, the next puts them in place.
    """
    stage = f".staging-{uuid.uuid4().hex}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = _system(root)
        attempt = str(TaskContext.get().taskAttemptId())
        rows = ((p, c) for b in batches for p, c in zip(b["file_path"].to_pylist(), b["code"].to_pylist()))
        yield pa.RecordBatch.from_pydict({"attempt": [attempt], "files": [_stage(system, f"{base}/{stage}/{attempt}", rows)]})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"files": [_place(system, f"{base}/{stage}/{a}", base) for a in batch["attempt"].to_pylist()]})

    spark, (system, base) = files.sparkSession, _system(root)
    try:
        # one row per task of those attempts that count
        staged = files.select("file_path", "code").mapInArrow(put, "attempt string, files long").where("files > 0").collect()
        system.create_dir(base, recursive=True)
        if staged:
            attempts = spark.createDataFrame(staged, "attempt string, files long").repartition(len(staged))
            attempts.mapInArrow(place, "files long").agg(F.sum("files")).collect()
    finally:
        _clear(system, f"{base}/{stage}")
