"""Word-processor packages as a data source: ``spark.read.format("docx")``, ``spark.readStream`` and ``df.write``.

:func:`register` makes the format known to a session. Options of a read:

* ``rows``: ``paragraphs`` (default), ``nodes``, ``numbering`` or ``files``. Only the entry of a package that holds these
  rows is fetched, so pictures and other parts are never read; ``files`` gives whole packages.
* ``partitionBytes`` (128 MB) and ``openBytes`` (256 KB): a task takes files up to this size, each counted with the cost
  of opening it. A package is never split.

The driver walks the folders one at a time and plans by folder: a task is given folders and the first and last name of its
share, and lists them itself. Only folders with more than 1,024 packages, which this format doesn't write, are dealt
file by file.

Conditions on ``path``, ``name`` and ``size`` leave files out before any task is planned. A package that can't be read is
one row with an ``error`` (not-a-package, no-document-part, bad-xml) and no content; one without numbering has no rows
of levels. Names that begin with ``_`` or ``.`` are passed over.

A write takes ``name`` and ``content`` (other columns are left out) and puts each row into a file of its own. Tasks write
to a staging folder; the job's commit gathers the attempts that counted and shows them by one renaming, as
``commit-<number>-<job>``, so a lost, repeated or killed task leaves no file. Mode ``append`` adds, mode ``overwrite``
takes away what was there after the new files have appeared. A task's files lie in folders of up to 512; rows that repeat
a name all stay, in folders of their own.

A stream reads commits in the order of their numbers, each once; writers of a folder that a stream reads take turns. The
folder must be one that all executors reach and that can rename folders: a mounted path, or a store that Arrow opens.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from xml.etree import ElementTree

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    Not,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from leafmill.model import RUNS
from leafmill.sources import docx

_FILE = "path string, name string, size bigint, modified timestamp, error string"
SCHEMAS = {
    "files": f"{_FILE}, content binary",
    "paragraphs": f"{_FILE}, para_idx int, text string, style string, num_id int, list_level int, table_no int, part string, runs {RUNS}",
    "nodes": f"{_FILE}, node_idx int, para_idx int, text string",
    "numbering": f"{_FILE}, num_id int, ilvl int, num_fmt string, lvl_text string, font string, is_image boolean",
}
_OWN = {
    "files": ("content",),
    "paragraphs": ("para_idx", "text", "style", "num_id", "list_level", "table_no", "part", "runs"),
    "nodes": ("node_idx", "para_idx", "text"),
    "numbering": ("num_id", "ilvl", "num_fmt", "lvl_text", "font", "is_image"),
}
#: Packages of a folder that a task lists itself, and that a task writes into one folder.
_LISTED, _WRITTEN = 1024, 512
_COMMIT = re.compile(r"commit-(\d+)-\w+\Z")


@dataclass(frozen=True)
class Found:
    """A file that a listing has met."""

    path: str
    size: int
    modified: datetime

    @property
    def name(self) -> str:
        return posixpath.basename(self.path)


@dataclass(frozen=True)
class Span:
    """The ``n`` wanted files of a folder whose names lie between two names, both included."""

    folder: str
    first: str
    last: str
    n: int


@dataclass
class Files(InputPartition):
    files: tuple[Found, ...] = ()
    spans: tuple[Span, ...] = ()


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    found, at = arrow_fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))
    return found, at.rstrip("/")


def _packages(store: arrow_fs.FileSystem, folder: str, allow_not_found: bool = False) -> tuple[list[Found], list[str]]:
    """The packages of a folder by name, and the folders in it, hidden ones left out."""
    got = [f for f in store.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=allow_not_found)) if f.base_name[:1] not in ("_", ".")]
    files = [Found(f.path, f.size, f.mtime) for f in got if f.type == arrow_fs.FileType.File and f.path.lower().endswith(".docx")]
    return sorted(files, key=lambda f: f.name), sorted(f.path for f in got if f.type == arrow_fs.FileType.Directory)


def walked(path: str, below: Iterable[str] = ("",)) -> Iterator[tuple[str, list[Found]]]:
    """Folders below some folders of ``path``, each with its packages: names, sizes and dates, nothing of their content."""
    store, root = _place(path)
    ahead = [f"{root}/{folder}".rstrip("/") for folder in reversed(list(below)) if not any(x[:1] in ("_", ".") for x in folder.split("/"))]
    while ahead:
        folder = ahead.pop()
        files, inner = _packages(store, folder, allow_not_found=True)
        yield folder, files
        ahead += reversed(inner)


def listed(path: str, below: Iterable[str] = ("",)) -> list[Found]:
    """All packages in some folders below ``path``."""
    return [f for _, files in walked(path, below) for f in files]


def commits(path: str) -> dict[int, list[str]]:
    """The folders of each commit number."""
    store, root = _place(path)
    out: dict[int, list[str]] = {}
    for f in store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
        if m := _COMMIT.match(f.base_name):
            out.setdefault(int(m[1]), []).append(f.base_name)
    return out


def planned(files: Iterable[Found], limit: int, opening: int) -> list[Files]:
    """Files dealt to tasks, large ones first, up to ``limit`` bytes a task."""
    out: list[Files] = []
    task: list[Found] = []
    held = 0
    for f in sorted(files, key=lambda f: (-f.size, f.path)):
        if task and held + f.size + opening > limit:
            out.append(Files(tuple(task)))
            task, held = [], 0
        task.append(f)
        held += f.size + opening
    return [*out, Files(tuple(task))] if task else out


def dealt(folders: Iterable[tuple[str, list[Found]]], tests: list[Callable[[Found], bool]], limit: int, opening: int) -> list[Files]:
    """The wanted files of folders dealt to tasks. Of a folder that is not very large only the ends of a share are kept."""
    out: list[Files] = []
    many: list[Found] = []
    spans: list[Span] = []
    held = 0
    for folder, files in folders:
        wanted = [f for f in files if all(test(f) for test in tests)]
        if len(files) > _LISTED:
            many += wanted
            continue
        share: list[Found] = []

        def end(share: list[Found], folder: str = folder) -> None:
            if share:
                spans.append(Span(folder, share[0].name, share[-1].name, len(share)))

        for f in wanted:
            if held and held + f.size + opening > limit:
                end(share)
                out.append(Files(spans=tuple(spans)))
                share, spans, held = [], [], 0
            share.append(f)
            held += f.size + opening
        end(share)
    return [*out, *([Files(spans=tuple(spans))] if spans else []), *planned(many, limit, opening)]


def shared(path: str, partition: Files, tests: list[Callable[[Found], bool]]) -> Iterator[Found]:
    """The files of a task. A folder that has lost files since it was planned is an error."""
    yield from partition.files
    store, _ = _place(path)
    for s in partition.spans:
        found = [f for f in _packages(store, s.folder)[0] if s.first <= f.name <= s.last and all(test(f) for test in tests)]
        if len(found) < s.n:
            raise FileNotFoundError(f"{s.folder} had {s.n} packages from {s.first} to {s.last}, now {len(found)}")
        yield from found


def _entry(source, name: str) -> bytes | None:
    """The bytes of one entry, None if there is no such entry."""
    try:
        with zipfile.ZipFile(source) as z:
            return z.read(name) if name in z.namelist() else None
    except (ValueError, *docx.UNREADABLE) as e:  # Arrow calls a seek before the start of a file a wrong value
        raise docx.PatchError("not-a-package") from e


def _package_rows(source, rows: str) -> list[dict]:
    if rows == "files":
        return [{"content": source.read()}]
    data = _entry(source, docx.NUMBERING if rows == "numbering" else docx.PART)
    if data is None and rows != "numbering":
        raise docx.PatchError("no-document-part")
    try:
        if rows == "numbering":
            return docx.level_rows(data) if data else []
        found = docx.paragraph_rows(data)
    except (ElementTree.ParseError, LookupError, ValueError) as e:
        raise docx.PatchError("bad-xml") from e
    if rows == "paragraphs":
        return found
    nodes = [(p["para_idx"], t) for p in found for t in p["nodes"]]
    return [{"node_idx": i, "para_idx": at, "text": t} for i, (at, t) in enumerate(nodes)]


def rows_of(path: str, files: Iterable[Found], rows: str) -> Iterator[tuple]:
    store, _ = _place(path)
    for f in files:
        error, got = None, []
        try:
            with store.open_input_file(f.path) as source:
                got = _package_rows(source, rows)
        except docx.PatchError as e:
            error = str(e)
        for r in [{}] if error else got:
            yield (f.path, f.name, f.size, f.modified, error, *(r.get(c) for c in _OWN[rows]))


_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
}


def wanted_files(condition: Filter) -> Callable[[Found], bool] | None:
    """A condition as a test of a listed file, None if only the rows can tell. No file lacks a path, name or size, so a
    negation is simply the opposite."""
    if isinstance(condition, Not):
        inner = wanted_files(condition.child)
        return None if inner is None else lambda f: not inner(f)
    test = _TESTS.get(type(condition))
    if test is None or len(condition.attribute) != 1 or condition.attribute[0] not in ("path", "name", "size"):
        return None
    return lambda f: test(getattr(f, condition.attribute[0]), condition.value)


class Reader(DataSourceReader):
    def __init__(self, path: str, rows: str, limit: int, opening: int):
        self.path, self.rows, self.limit, self.opening = path, rows, limit, opening
        self.tests: list[Callable[[Found], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = wanted_files(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        return dealt(walked(self.path), self.tests, self.limit, self.opening) or [Files()]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, shared(self.path, partition, self.tests), self.rows)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, rows: str, limit: int, opening: int):
        self.path, self.rows, self.limit, self.opening = path, rows, limit, opening

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max(commits(self.path), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = [x for n, folders in commits(self.path).items() if start["commit"] < n <= end["commit"] for x in folders]
        return dealt(walked(self.path, new), [], self.limit, self.opening)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, shared(self.path, partition, []), self.rows)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"_staging-{self.job}"

    def begin(self) -> None:
        """Makes the staging folder, once a job. Tasks never do, so one that outlives its job has nowhere to write."""
        store, root = _place(self.path)
        store.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator) -> Attempt:
        store, root = _place(self.path)
        attempt, folders, seen = uuid.uuid4().hex, 0, set()
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content")):
                name = name.as_py()
                if not name or "/" in name or "\\" in name or name[0] in "_." or not name.lower().endswith(".docx") or not content.is_valid:
                    raise ValueError(f"no name and content of a package: {name!r}")
                if not folders:
                    store.create_dir(f"{root}/{self.staging}/{attempt}", recursive=False)
                if not folders or len(seen) == _WRITTEN or name in seen:
                    folders, seen = folders + 1, set()
                    store.create_dir(f"{root}/{self.staging}/{attempt}/{folders:06d}", recursive=False)
                seen.add(name)
                with store.open_output_stream(f"{root}/{self.staging}/{attempt}/{folders:06d}/{name}") as out:
                    out.write(content.as_buffer())
        return Attempt(attempt if folders else None)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = _place(self.path)
        before = [f for f in store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)) if f.base_name[0] not in "_."]
        number = max(commits(self.path), default=0) + 1
        ready = f"{root}/_ready-{self.job}"
        store.create_dir(ready, recursive=True)
        for m in messages:
            if m and m.folder:
                store.move(f"{root}/{self.staging}/{m.folder}", f"{ready}/{m.folder}")
        store.move(ready, f"{root}/commit-{number:09d}-{self.job}")
        self._clear()
        for f in before if self.overwrite else ():
            store.delete_dir(f.path) if f.type == arrow_fs.FileType.Directory else store.delete_file(f.path)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _place(self.path)
        for name in (self.staging, f"_ready-{self.job}"):
            if store.get_file_info(f"{root}/{name}").type == arrow_fs.FileType.Directory:
                gone = f"{root}/_gone{name}"  # tasks still at work lose the folder at once, then it is emptied
                store.move(f"{root}/{name}", gone)
                store.delete_dir(gone)


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def _asked(self) -> tuple[str, str, int, int]:
        rows = self.options.get("rows", "paragraphs")
        if rows not in SCHEMAS:
            raise ValueError(f"rows is one of {', '.join(SCHEMAS)}")
        return self._path(), rows, int(self.options.get("partitionBytes", 128 << 20)), int(self.options.get("openBytes", 256 << 10))

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("the format docx needs a path")
        return self.options["path"]

    def schema(self) -> str:
        return SCHEMAS[self._asked()[1]]

    def reader(self, schema) -> Reader:
        return Reader(*self._asked())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._asked())

    def writer(self, schema, overwrite: bool) -> Writer:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds.get("name") != "string" or kinds.get("content") != "binary":
            raise ValueError("a write needs the columns name string and content binary")
        writer = Writer(self._path(), overwrite)
        writer.begin()
        return writer


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocxSource)
