"""Trees of source files as a data source: `spark.read.format("source_tree")` lists and reads them, `df.write` makes them.

Spark's own file listing leaves out every name that begins with an underscore or a dot, `__init__.py` among them; this one
lists folders itself. Paths are URIs or local paths; folders are reached through pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "project_id string, relative_path string, content binary, size_bytes bigint"
#: Bytes and rows of one batch that a reader hands on, about.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024
#: Partitions at most for each that is wanted: more subtrees than that are dealt over them, as each task costs the driver memory and time.
MOST_PARTITIONS = 4
#: Entries of one folder that the driver lists at most, and folders that it holds: what is larger is dealt among tasks by name.
MOST_LISTED, MOST_HELD = 4096, 20_000
#: Files that a commit moves at a time, and the name of a task's list of its files.
MOVERS, LISTED = 16, "_listed"
#: How the folder of a write that is going on begins; no project.
MAKING = "_making-"
#: Bytes of one file that a writer holds before it writes them.
WRITE_BYTES = 1 << 20


def opened(root: str):
    """A file system and the path of the root in it."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(root)
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root)


def _children(store, folder: str) -> list:
    """Entries of a folder in order of their names; a folder that is gone has none, and links to folders aren't followed."""
    from pyarrow import fs

    local = isinstance(store, fs.LocalFileSystem)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((x for x in found if not (local and x.type == fs.FileType.Directory and os.path.islink(x.path))), key=lambda x: x.base_name)


def _few_children(store, folder: str) -> list | None:
    """`_children`, or None where a local folder has more than MOST_LISTED: these are counted without holding them."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem) and os.path.isdir(folder):
        with os.scandir(folder) as entries:
            if sum(1 for _ in islice(entries, MOST_LISTED + 1)) > MOST_LISTED:
                return None
    found = _children(store, folder)
    return None if len(found) > MOST_LISTED else found


def slot(name: str, slots: int) -> int:
    """Which of the tasks that share a folder takes an entry."""
    return zlib.crc32(name.encode(errors="surrogateescape")) % slots


def _is_folder(entry) -> bool:
    from pyarrow import fs

    return entry.type == fs.FileType.Directory


@dataclass
class Subtrees(InputPartition):
    """(project, folder, whether its subfolders belong to it, slot, slots) of one task: entries of the folder whose name falls
    into the slot. A project of None: the root itself; its subfolders are projects."""

    parts: list


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.most = int(options.get("maxBytes", str(1 << 62)))
        self.ignored = [x for x in options.get("ignoredFolders", "").lower().split(",") if x]
        self.hidden = options.get("hiddenFolders", "true").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.wanted = int(options.get("partitions", "64"))
        self.projects: set[str] | None = None

    def pushFilters(self, filters):
        """Equality with project_id leaves out other projects' folders; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("project_id",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.projects = named if self.projects is None else self.projects & named
            yield f

    def _goes(self, entry) -> bool:
        name = entry.base_name
        return name.lower() not in self.ignored and (self.hidden or not name.startswith("."))

    def partitions(self):
        """Subtrees: the projects' folders, and where these are few, their subfolders, level by level until there are enough."""
        store, root = opened(self.root)
        top = _few_children(store, root)
        if top is None:
            return [Subtrees([(None, root, True, i, self.wanted)]) for i in range(self.wanted)]
        top = [x for x in top if not x.base_name.startswith(MAKING)]
        tasks = [(None, root, False, 0, 1)] if any(not _is_folder(x) for x in top) and (self.projects is None or "" in self.projects) else []
        level = [(x.base_name, x.path) for x in top if _is_folder(x) and (self.projects is None or x.base_name in self.projects)]
        while level and len(tasks) + len(level) < self.wanted:
            below, share = [], -(-self.wanted // len(level))
            for project, folder in level:
                found = _few_children(store, folder) if len(below) + len(tasks) < MOST_HELD else None
                if found is None:
                    tasks += [(project, folder, True, i, share) for i in range(share)]
                    continue
                tasks.append((project, folder, False, 0, 1))
                below += [(project, x.path) for x in found if _is_folder(x) and self._goes(x)]
            level = below
        tasks += [(project, folder, True, 0, 1) for project, folder in level]
        parts = min(len(tasks), MOST_PARTITIONS * self.wanted)
        return [Subtrees(tasks[i::parts]) for i in range(parts)] or [Subtrees([])]

    def _files(self, store, folder: str, deep: bool, own: int = 0, slots: int = 1) -> Iterator:
        todo, first = [folder], True
        while todo:
            entries = [x for x in _children(store, todo.pop()) if not first or slots == 1 or slot(x.base_name, slots) == own]
            first = False
            yield from (x for x in entries if not _is_folder(x) and (x.size is None or x.size <= self.most))
            if deep:
                todo += [x.path for x in reversed(entries) if _is_folder(x) and self._goes(x)]

    def _parts(self, store, partition) -> Iterator:
        """(project, folder, whether its subfolders belong to it, slot, slots), with the projects of a shared root by themselves."""
        for project, folder, deep, own, slots in partition.parts:
            if project is not None or not deep:
                yield project, folder, deep, own, slots
                continue
            if self.projects is None or "" in self.projects:
                yield None, folder, False, own, slots
            for x in _children(store, folder):
                if _is_folder(x) and slot(x.base_name, slots) == own and not x.base_name.startswith(MAKING) and (self.projects is None or x.base_name in self.projects):
                    yield x.base_name, x.path, True, 0, 1

    def _read(self, store, path: str) -> bytes | None:
        try:
            with store.open_input_stream(path) as f:
                return f.read()
        except OSError:
            return None

    def read(self, partition):
        store, root = opened(self.root)
        columns, held = ([], [], [], []), 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["project_id", "relative_path", "content", "size_bytes"])

        for project, folder, deep, own, slots in self._parts(store, partition):
            base = root.rstrip("/") if project is None else f"{root.rstrip('/')}/{project}"
            for x in self._files(store, folder, deep, own, slots):
                data = self._read(store, x.path) if self.content else None
                for column, value in zip(columns, (project or "", x.path[len(base) + 1 :], data, x.size), strict=True):
                    column.append(value)
                held += len(data or b"") + 64
                if held >= BATCH_BYTES or len(columns[0]) >= BATCH_ROWS:
                    yield batch()
                    columns, held = ([], [], [], []), 0
        if columns[0]:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    """The list of one task's files: its path, a line of JSON (temporary path, path) for each; None of a task without files."""

    listed: str | None


def inside(root: str, project: str, path: str) -> str:
    """The file's place; one that would leave its project's folder is an error."""
    parts = [x for x in path.replace("\\", "/").split("/") if x not in ("", ".")]
    if not parts or ".." in parts or project in ("..", ".") or "/" in project or "\\" in project:
        raise ValueError(f"no place inside the tree: {project!r}, {path!r}")
    return "/".join([root.rstrip("/"), *([project] if project else []), *parts])


class TreeWriter(DataSourceArrowWriter):
    """A file for each (project_id, relative_path); rows of one file that follow each other are its content in pieces.

    A task writes under temporary names and lists them in a file; the commit reads the lists of the tasks that Spark accepted
    and moves what they name, so a lost executor or a repeated task leaves nothing half written, and the driver never holds
    all names. A file that is there already is replaced; of one that several tasks wrote, some task's stays.
    """

    def __init__(self, options):
        self.root = options["path"]
        self.making = f"{MAKING}{uuid.uuid4().hex}"

    def _made(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.making}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.root)
        mark, last, held, size = uuid.uuid4().hex, None, [], 0
        stream = listed = None
        mine = f"{self._made(root)}/{mark}"
        for batch in iterator:
            projects, paths, contents = (batch.column(batch.schema.get_field_index(n)) for n in ("project_id", "relative_path", "content"))
            for project, path, content in zip(projects.to_pylist(), paths.to_pylist(), contents.to_pylist(), strict=True):
                if (project, path) != last:
                    if stream:
                        stream.write(b"".join(held))
                        stream.close()
                    final = inside(root, project or "", path)
                    temporary = f"{mine}/{hashlib.sha256(final.encode()).hexdigest()}"
                    if listed is None:
                        store.create_dir(mine)
                        listed = store.open_output_stream(f"{mine}/{LISTED}", buffer_size=1 << 16)
                    stream, last, held, size = store.open_output_stream(temporary), (project, path), [], 0
                    listed.write(json.dumps([temporary, final]).encode() + b"\n")
                data = content.encode() if isinstance(content, str) else content or b""
                held.append(data)
                size += len(data)
                if size >= WRITE_BYTES:
                    stream.write(b"".join(held))
                    held, size = [], 0
        if stream:
            stream.write(b"".join(held))
            stream.close()
            listed.close()
        return Written(f"{mine}/{LISTED}" if listed else None)

    def commit(self, messages) -> None:
        """Moves the files of the lists, some at a time: no more of them are held."""
        store, root = opened(self.root)

        def move(line: str) -> None:
            temporary, final = json.loads(line)
            store.create_dir(final.rsplit("/", 1)[0])
            store.move(temporary, final)

        lists = [m.listed for m in messages if m and m.listed]
        with ThreadPoolExecutor(MOVERS) as movers:
            for path in lists:
                with store.open_input_stream(path, buffer_size=1 << 16) as f:
                    rest = b""
                    while data := f.read(1 << 18):
                        *lines, rest = (rest + data).split(b"\n")
                        for _ in movers.map(move, lines):
                            pass
        if lists:
            store.delete_dir(self._made(root))

    def abort(self, messages) -> None:
        store, root = opened(self.root)
        store.delete_dir(self._made(root))


class TreeSource(DataSource):
    """Options: path; for reading also maxBytes, ignoredFolders (names, with commas), hiddenFolders, content, partitions."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options)
