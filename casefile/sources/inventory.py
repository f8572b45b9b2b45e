"""File-attribute inventory of a directory tree as a Spark data source.

``spark.read.format("file_inventory").load(dir)`` lists every file with its
attributes.  Unlike the binary-file reader it keeps zero-length files.
Names starting with ``.`` or ``_`` are skipped (files and directories) unless
``includeHidden`` is set, the same rule the binary-file reader applies.

Local folders (mounted at the same path on every worker) give POSIX
attributes.  Other URIs are listed through the pyarrow file system of their
scheme: path, length and modification time, the rest NULL.  HDFS-only fields
(block size, replication, checksum) are NULL.

Nothing is lost silently.  A root that does not exist, or a scheme without a
file system, raises.  An entry whose attributes cannot be read, and a folder
that cannot be listed, is a row with its path and the reason in ``error``.
Bytes of a name that are not UTF-8 are percent-encoded, as is ``%`` in such
names, so every name is distinct.

Partitioning: the driver expands the tree breadth-first only until it has
``targetPartitions`` directories (or the tree ends).  A directory is listed
once, by one process; of a directory with many files the names go to
``filesPerSlice`` at a time as work units, so that the attribute lookups
(``stat``, extended attributes), which are the slow part, spread over tasks.
Each remaining subtree is walked by an executor task.  With ``sizeOnly`` no
attributes but the size are looked up.  Remote folders are expanded likewise; as
a remote listing brings the attributes, a task lists the files of an expanded
folder again instead of getting their names.
"""

from __future__ import annotations

import functools
import os
import stat as pystat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

INVENTORY_DDL = (
    "path string, owner string, group string, permissions string, length bigint, "
    "block_size bigint, replication int, access_time bigint, modification_time bigint, "
    "checksum string, checksum_algorithm string, xattrs map<string,string>, error string"
)

FILES_PER_SLICE = 20000
ROWS_PER_BATCH = 8192
_FIELDS = ["path", "owner", "group", "permissions", "length", "block_size", "replication",
           "access_time", "modification_time", "checksum", "checksum_algorithm", "xattrs", "error"]


def _arrow_schema():
    import pyarrow as pa

    s, i64 = pa.string(), pa.int64()
    return pa.schema([("path", s), ("owner", s), ("group", s), ("permissions", s), ("length", i64),
                      ("block_size", i64), ("replication", pa.int32()), ("access_time", i64),
                      ("modification_time", i64), ("checksum", s), ("checksum_algorithm", s),
                      ("xattrs", pa.map_(s, s)), ("error", s)])


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_")


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return path


def _readable(path: str) -> str:
    """The path as valid text: undecodable bytes, and ``%`` beside them, are percent-encoded."""
    try:
        path.encode("utf-8")
        return path
    except UnicodeEncodeError:
        return "".join(f"%{ord(c) - 0xDC00:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else "%25" if c == "%" else c
                       for c in path)


def _uri(path: str) -> str:
    return "file:" + _readable(os.path.abspath(path))


def _names_unit(directory: str, names: list[str]) -> InputPartition:
    """Files of ``directory`` by name."""
    return InputPartition(("names", directory, names))


def _tree_unit(directories: list[str]) -> InputPartition:
    """Whole subtrees, walked by the task."""
    return InputPartition(("trees", list(directories), None))


def _scan(directory: str, include_hidden: bool):
    """``(files, subdirectories)`` of one directory; an entry that cannot be judged counts as a file."""
    files, dirs = [], []
    with os.scandir(directory) as it:
        for entry in it:
            if not include_hidden and _hidden(entry.name):
                continue
            try:
                is_dir = entry.is_dir(follow_symlinks=False)
                if not is_dir and not entry.is_file() and entry.is_dir():
                    continue  # a link to a folder
            except OSError:
                is_dir = False
            (dirs if is_dir else files).append(entry.path)
    return files, dirs


@functools.lru_cache(maxsize=4096)
def _user_name(uid: int) -> str:
    import pwd

    try:
        return pwd.getpwuid(uid).pw_name
    except (KeyError, OverflowError):
        return str(uid)


@functools.lru_cache(maxsize=4096)
def _group_name(gid: int) -> str:
    import grp

    try:
        return grp.getgrgid(gid).gr_name
    except (KeyError, OverflowError):
        return str(gid)


def _attributes(path: str, size_only: bool = False):
    st = os.stat(path)
    if size_only:
        return (_uri(path), None, None, None, int(st.st_size), *[None] * 8)
    xattrs = {}
    try:
        for key in os.listxattr(path):
            try:
                xattrs[key] = os.getxattr(path, key).decode("utf-8", "replace")
            except OSError:
                continue
    except (OSError, AttributeError):
        xattrs = {}
    return (
        _uri(path),
        _user_name(st.st_uid),
        _group_name(st.st_gid),
        pystat.filemode(st.st_mode)[1:],
        int(st.st_size), None, None,
        int(st.st_atime_ns // 1_000_000), int(st.st_mtime_ns // 1_000_000),
        None, None, list(xattrs.items()), None,
    )


def _reason(error: OSError) -> str:
    return f"{type(error).__name__}: {os.strerror(error.errno) if error.errno else error}"


def _failed(path: str, error: OSError):
    return (_uri(path), *[None] * 11, _reason(error))


class FileInventoryReader(DataSourceReader):
    def __init__(self, options):
        self.given = options.get("path", "")
        self.remote = "://" in self.given and not self.given.startswith("file:")
        self.root = self.given if self.remote else _local(self.given)
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.include_hidden = str(options.get("includeHidden", "false")).lower() == "true"
        self.size_only = str(options.get("sizeOnly", "false")).lower() == "true"
        self.target = max(1, int(options.get("targetPartitions", "64")))
        self.files_per_slice = max(1, int(options.get("filesPerSlice", str(FILES_PER_SLICE))))

    def partitions(self):
        if self.remote:
            return self._remote_partitions()
        if os.path.isfile(self.root):
            return [InputPartition(("file", self.root, None))]
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.given)
        units, frontier = [], [self.root]
        while frontier and len(frontier) < self.target:
            next_frontier = []
            for directory in frontier:
                try:
                    files, dirs = _scan(directory, self.include_hidden)
                except OSError:
                    units.append(_tree_unit([directory]))  # its task reports why
                    continue
                names = sorted(os.path.basename(f) for f in files)
                units += [_names_unit(directory, names[k:k + self.files_per_slice])
                          for k in range(0, len(names), self.files_per_slice)]
                next_frontier += dirs
            frontier = next_frontier if self.recursive else []
        n_tree_units = min(len(frontier), self.target)
        units.extend(_tree_unit(frontier[k::n_tree_units]) for k in range(n_tree_units))
        return units or [_tree_unit([])]

    def _remote_partitions(self):
        """One unit for a file or a flat listing; else folders whose files are listed, and subtrees that are walked."""
        from pyarrow import fs

        system, root = _remote(self.root)
        kind = system.get_file_info(root).type
        if kind == fs.FileType.NotFound:
            raise FileNotFoundError(self.given)
        if kind == fs.FileType.File or not self.recursive:
            return [InputPartition(("remote", [root], False))]
        flat, trees, frontier = [], [], [root]
        while frontier and len(frontier) < self.target:
            next_frontier = []
            for directory in frontier:
                try:
                    entries = system.get_file_info(fs.FileSelector(directory))
                except OSError:
                    trees.append(directory)  # its task gives the reason
                    continue
                if any(entry.type != fs.FileType.Directory for entry in entries):
                    flat.append(directory)
                next_frontier += [entry.path for entry in entries if entry.type == fs.FileType.Directory
                                  and (self.include_hidden or not _hidden(entry.base_name))]
            frontier = next_frontier
        trees += frontier
        units = [InputPartition(("remote", dirs[k::self.target], walked))
                 for dirs, walked in ((flat, False), (trees, True)) for k in range(min(len(dirs), self.target))]
        return units or [_tree_unit([])]

    def _rows(self, unit):
        kind, where, names = unit
        if kind == "remote":
            yield from _remote_rows(self.root, names, self.include_hidden, where)
            return
        if kind in ("file", "names"):
            for path in [where] if kind == "file" else (os.path.join(where, n) for n in names):
                yield self._row(path)
            return
        for top in where:
            stack = [top]
            while stack:
                directory = stack.pop()
                try:
                    files, dirs = _scan(directory, self.include_hidden)
                except OSError as error:
                    yield _failed(directory, error)
                    continue
                for path in sorted(files):
                    yield self._row(path)
                stack.extend(dirs)

    def _row(self, path):
        try:
            return _attributes(path, self.size_only)
        except OSError as error:
            return _failed(path, error)

    def read(self, partition):
        """Yield Arrow record batches of ``ROWS_PER_BATCH`` files (no per-row conversion)."""
        import pyarrow as pa

        schema = _arrow_schema()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)],
                                              schema=schema)

        rows = []
        for row in self._rows(partition.value):
            rows.append(row)
            if len(rows) >= ROWS_PER_BATCH:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


def _remote(uri: str):
    """The file system of a URI's scheme and the path in it; an unknown scheme raises."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _remote_rows(uri: str, recursive: bool, include_hidden: bool, tops: list[str] | None = None):
    """Rows of a folder, or of the folders ``tops`` in it, listed by a pyarrow file system, one folder at a time."""
    from pyarrow import fs

    system, root = _remote(uri)
    prefix = uri.split("://", 1)[0] + "://"
    authority = "" if not root.startswith("/") else uri.split("://", 1)[1].split("/", 1)[0]
    stack = [root] if tops is None else list(tops)
    while stack:
        here = stack.pop()
        try:
            info = system.get_file_info(here)
            entries = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(here))
        except OSError as error:
            if here == root:
                raise
            yield (prefix + authority + here, *[None] * 11, _reason(error))
            continue
        for entry in entries:
            if entry.path != root and not include_hidden and _hidden(entry.base_name):
                continue
            if entry.type == fs.FileType.Directory:
                if recursive:
                    stack.append(entry.path)
                continue
            modified = entry.mtime_ns // 1_000_000 if entry.mtime_ns else None
            yield (prefix + authority + entry.path, None, None, None, entry.size, None, None, None, modified, None, None,
                   None, None)


class FileInventoryDataSource(DataSource):
    @classmethod
    def name(cls):
        return "file_inventory"

    def schema(self):
        return INVENTORY_DDL

    def reader(self, schema):
        return FileInventoryReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileInventoryDataSource)


def file_inventory(spark: SparkSession, directory: str, recursive: bool = True,
                   include_hidden: bool = False, target_partitions: int | None = None,
                   files_per_slice: int = FILES_PER_SLICE, size_only: bool = False) -> DataFrame:
    """Attributes of every file below ``directory`` (zero-length files included)."""
    register(spark)
    target = target_partitions or spark.sparkContext.defaultParallelism * 4
    return (spark.read.format("file_inventory")
            .option("recursive", str(recursive).lower())
            .option("includeHidden", str(include_hidden).lower())
            .option("targetPartitions", str(target))
            .option("filesPerSlice", str(files_per_slice))
            .option("sizeOnly", str(size_only).lower())
            .load(directory))


def unreadable_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """(path, error) of the entries below ``directory`` that could not be listed: dangling links, closed folders."""
    return file_inventory(spark, directory, recursive).where("error is not null").select("path", "error")


def zero_length_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """``(path)`` of zero-length files, which the binary-file reader skips."""
    return file_inventory(spark, directory, recursive, size_only=True).where("length = 0").select("path")
