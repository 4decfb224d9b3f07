"""Files that Spark has no format for: listing, range reads and a sink, in any store that pyarrow reaches.

Paths are local or URIs (``file:``, ``hdfs:``, ``s3:`` or ``s3a:``, ``gs:``). Nothing here reads a whole
file unless it is asked for; what a reader of headers needs comes in pages.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, InputPartition, WriterCommitMessage

#: Bytes of a page of range reads, pages that are kept, and threads that look into files while a scan is planned.
PAGE, PAGES, THREADS = 1 << 16, 64, 32
#: Bytes of files that one partition of a scan reads, about.
PARTITION_BYTES = 32 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), str(Path(path).absolute())


def listing(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files with a suffix: of a folder and those below it, or one file; sorted."""
    system, inner = store(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    base = path.rstrip("/")
    return sorted((base + f.path[len(inner.rstrip("/")) :], f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


class Ranged:
    """A file's bytes by slices, read in pages: ``data[a:b]`` like a bytes object's."""

    def __init__(self, path: str):
        system, inner = store(path)
        self.file, self.pages = system.open_input_file(inner), {}
        self.size = self.file.size()

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        """n bytes from ``at`` in one read, past the pages."""
        return self.file.read_at(n, at)

    def __getitem__(self, part: slice) -> bytes:
        first, last, _ = part.indices(self.size)
        if last - first > PAGE:
            return self.read(first, last - first)
        out = b""
        for p in range(first // PAGE, -(-last // PAGE) if last > first else first // PAGE):
            if p not in self.pages:
                if len(self.pages) >= PAGES:
                    self.pages.pop(next(iter(self.pages)))
                self.pages[p] = self.read(p * PAGE, PAGE)
            out += self.pages[p][max(0, first - p * PAGE) : last - p * PAGE]
        return out


def looked_into(paths: Iterable[str], look) -> list:
    """``look`` of an open file for each path, in order, on several threads."""

    def one(path: str):
        with Ranged(path) as data:
            return look(path, data)

    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(one, paths))


@dataclass
class Spans(InputPartition):
    """What one task reads: (path, first, behind the last) of each of some files."""

    spans: tuple[tuple[str, int, int], ...]

    def __init__(self, spans):
        super().__init__(None)
        self.spans = tuple(spans)


def partitions(items: Iterable[tuple[str, list[int]]], most: int) -> list[Spans]:
    """Runs of pieces of about ``most`` bytes: ``items`` has the sizes of each file's pieces."""
    out, now, held = [], [], 0
    for path, sizes in items:
        first = 0
        for k, size in enumerate(sizes):
            if held and held + size > most:
                if k > first:
                    now.append((path, first, k))
                out.append(Spans(now))
                now, held, first = [], 0, k
            held += size
        if len(sizes) > first:
            now.append((path, first, len(sizes)))
    return [*out, Spans(now)] if now else out


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, by Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_cairnfield_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="cairnfield-")) / "cairnfield_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "cairnfield").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._cairnfield_shipped = True


# sink


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """Each row's content as a file. Tasks write below a folder of the job; the commit moves the files.

    A task that is run again writes the same names anew, and files of a task or a job that failed are never moved.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()
        system, inner = store(self.path)
        names = []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if not name or name.startswith(("/", ".")) or ".." in name:
                    raise ValueError(f"{name!r} can't be a file's name")
                to = f"{inner}/_temporary-{self.job}/{task}/{name}"
                system.create_dir(to.rpartition("/")[0], recursive=True)
                with system.open_output_stream(to) as out:
                    out.write(content.as_buffer())
                names.append(f"{task}/{name}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = store(self.path)
        moves = [n for m in messages if m for n in m.names]
        ends = [n.partition("/")[2] for n in moves]
        if len(set(ends)) < len(ends):
            raise ValueError("Two rows have the same file name")
        if self.overwrite and system.get_file_info(inner).type == fs.FileType.Directory:
            for f in system.get_file_info(fs.FileSelector(inner)):
                if f.base_name != f"_temporary-{self.job}":
                    (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)
        system.create_dir(inner, recursive=True)
        for folder in {e.rpartition("/")[0] for e in ends if "/" in e}:
            system.create_dir(f"{inner}/{folder}", recursive=True)
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda m: system.move(f"{inner}/_temporary-{self.job}/{m[0]}", f"{inner}/{m[1]}"), zip(moves, ends, strict=True)))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = store(self.path)
        if system.get_file_info(f"{inner}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/_temporary-{self.job}")


class NamedFiles(DataSource):
    """Sink ``named_files``: rows (name, content) become files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows (name, content) as files below ``path``; ``mode`` is overwrite or append."""
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode(mode).option("path", path).save()
