"""Files and archive members as a data source: ``spark.read.format("quill")`` and ``df.write.format("quill")``.

Reading gives a row ``(path, member, length, content)`` for each file, and with the option ``archives`` a row for each
member of a ZIP or tar file. Partitions are planned by bytes: small files share one, and a ZIP's members are dealt to as many as
their sizes ask for, from its directory alone; a tar file has no directory and is read by one task.

Writing takes ``output_name`` and ``output`` (text) or ``output_data`` (bytes) and is done in two phases: each attempt of a task
writes to a folder of its own inside a staging folder, and when all tasks have ended well the driver moves the files of
the attempts that count into place. A job that fails leaves no file; a name that two rows have fails the job before anything
is moved. A file is there whole or not at all. An attempt that still runs when its job fails may leave its staging folder, which
reading passes over. Folders are those that driver and executors share, as paths or URIs.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

READ_SCHEMA = "path string, member string, length long, content binary"
#: Bytes that a partition reads unless told otherwise, and what opening a file counts for.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 4 << 20
_STAGING = "_quill-staging-"


def _system(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


def _listed(path: str, pattern: str | None) -> list[tuple[str, int]]:
    """Files at or below a path with their sizes, by name; those whose names begin with a dot or underscore are passed over."""
    import fnmatch

    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x.startswith((".", "_")) for x in posixpath.relpath(p, root).split("/") if x != ".")
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path) and (not pattern or fnmatch.fnmatch(f.base_name, pattern)))


@dataclass
class Share(InputPartition):
    """What one task reads: files with no member named are read whole, or member by member if they are archives."""

    items: list[tuple[str, str | None]] = field(default_factory=list)
    size: int = 0

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        super().__init__(None)
        self.items, self.size = items, size


def shares(sized: list[tuple[tuple[str, str | None], int]], most: int) -> list[Share]:
    """Items in order, as many a share as its bytes allow; one larger item is a share."""
    out: list[Share] = []
    for item, size in sized:
        size += OPEN_BYTES if item[1] is None else 0
        if out and out[-1].size + size <= most:
            out[-1].items.append(item)
            out[-1].size += size
        else:
            out.append(Share([item], size))
    return out


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not (path := options.get("path")):
            raise ValueError("a path is needed: load(path)")
        self.path, self.pattern = path, options.get("pathglobfilter")
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.archives = options.get("archives", "false").lower() == "true"

    def partitions(self) -> list[Share]:
        system, _ = _system(self.path)
        sized: list[tuple[tuple[str, str | None], int]] = []
        for path, size in _listed(self.path, self.pattern):
            if self.archives and path.lower().endswith(".zip"):
                with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    sized += [((path, x.filename), x.file_size) for x in z.infolist() if not x.is_dir()]
            else:
                sized.append(((path, None), size))
        return shares(sized, self.most) or [Share([], 0)]

    def read(self, partition: Share) -> Iterator[tuple]:
        system, _ = _system(self.path)
        held, name = None, None  # the archive that is open: its members follow each other
        for path, member in partition.items:
            if member is not None:
                if path != name:
                    held, name = zipfile.ZipFile(system.open_input_file(path)), path
                data = held.read(member)
                yield path, member, len(data), data
            elif self.archives and path.lower().endswith((".tar", ".tar.gz", ".tgz")):
                with system.open_input_stream(path, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as t:
                    for x in t:
                        if x.isfile():
                            data = t.extractfile(x).read()
                            yield path, x.name, len(data), data
            else:
                with system.open_input_file(path) as f:
                    data = f.read()
                yield path, None, len(data), data


@dataclass
class Written(WriterCommitMessage):
    """The folder of one attempt, and the names of its files."""

    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        if not (path := options.get("path")):
            raise ValueError("a path is needed: save(path)")
        self.path, self.overwrite, self.staging = path, overwrite, f"{_STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, root = _system(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        names: dict[str, None] = {}
        for r in iterator:
            name = r["output_name"]
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"not a file's name: {name!r}")
            if name in names:
                raise ValueError(f"two rows have the name {name}")
            row = r.asDict()
            data = row.get("output_data")
            data = bytes(data) if data is not None else (row.get("output") or "").encode()
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write(data)
            names[name] = None
        return Written(folder, list(names))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _system(self.path)
        done = [m for m in messages if m is not None]
        every = [n for m in done for n in m.names]
        if len(set(every)) < len(every):
            self.abort(messages)
            raise ValueError(f"two rows have the name {min(n for n, k in Counter(every).items() if k > 1)}")
        system.create_dir(root, recursive=True)
        old = {f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File} if self.overwrite else set()
        for m in done:
            for n in m.names:
                system.move(f"{m.folder}/{n}", f"{root}/{n}")
        for n in old - set(every):
            system.delete_file(f"{root}/{n}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class QuillFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill"

    def schema(self) -> str:
        return READ_SCHEMA

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> FilesReader:
        return FilesReader(self._options())

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        names = {f.name for f in schema}
        if "output_name" not in names or not names & {"output", "output_data"}:
            raise ValueError("rows to be written have output_name, and output or output_data")
        return FilesWriter(self._options(), overwrite)


def register_files(spark: SparkSession) -> None:
    """The format ``quill`` for this session."""
    from quillspark.plans.ship import ship

    ship(spark)
    spark.dataSource.register(QuillFiles)


def zipped(members: dict[str, bytes]) -> bytes:
    """A ZIP file of these members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()
