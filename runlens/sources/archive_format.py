"""S13 as a data source: ``spark.read.format("log_archives")``, one partition for each archive.

Filters on ``member`` are pushed into the stream, where other members are passed over; filters on
``archive`` leave out whole archives. A schema with some of the columns keeps the others from being
sent to Spark. Needs ``spark.sql.python.filterPushdown.enabled`` for the filters to be pushed.
"""

import fnmatch
import re

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from runlens.sources.archives import LINES, SUFFIX, _line_reader, _member_pattern, archived_table

NAME = "log_archives"
_COLUMNS = ["archive", "member", "line_no", "line"]


def list_archives(glob):
    """The paths that match ``glob`` (``*``, ``?`` and ``[...]`` within a level), as Spark names them."""
    from pyarrow import fs

    parts = re.sub(r"^file:/+", "/", glob).split("/")
    at = next((i for i, x in enumerate(parts) if re.search(r"[*?\[]", x)), len(parts))
    base = "/".join(parts[:at])
    scheme = re.match(r"[a-z][a-z0-9+.-]*://", base, re.I)
    filesystem, inside = fs.FileSystem.from_uri(base) if scheme else (fs.LocalFileSystem(), base or "/")
    above = base if scheme else f"file:{base}"
    if at == len(parts):
        return [above]
    level = [(inside.rstrip("/"), above)]
    for i, pattern in enumerate(parts[at:], at + 1):
        kind = fs.FileType.File if i == len(parts) else fs.FileType.Directory
        level = [
            (entry.path, f"{name}/{entry.base_name}")
            for path, name in level
            for entry in filesystem.get_file_info(fs.FileSelector(path or "/", allow_not_found=True))
            if entry.type == kind and fnmatch.fnmatchcase(entry.base_name, pattern)
        ]
    return sorted(name for _, name in level)


class Archive(InputPartition):
    """One archive."""


class ArchiveReader(DataSourceReader):
    """Reads the lines of archives, one partition each."""

    def __init__(self, schema, options):
        self.columns = schema.fieldNames()
        if unknown := set(self.columns) - set(_COLUMNS):
            raise ValueError(f"no columns of an archive: {sorted(unknown)}")
        self.glob = options["path"]
        self.suffix = options.get("suffix", SUFFIX)
        self.batch_rows = int(options.get("batch_rows", 20000))
        # Each pattern must be found in a member's path, after a leading slash.
        self.patterns = [options["members"]] if options.get("members") else []
        self.archives = []

    def pushFilters(self, filters):
        """Filters on members are done in the stream; Spark goes on to check those on archives."""
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if isinstance(f, IsNotNull) and name[0] in _COLUMNS:
                continue
            pattern = _pattern(f) if name == ("member",) else None
            if pattern is not None:
                self.patterns.append(pattern)
                continue
            if name == ("archive",):
                self.archives.append(f)
            yield f

    def partitions(self):
        """The archives that can hold rows for the filters."""
        found = list_archives(self.glob)
        return [Archive(x) for x in found if all(self._may_hold(f, x) for f in self.archives)] or [
            Archive(None)
        ]

    def _may_hold(self, f, path):
        """Whether ``path``, or an archive inside it, can satisfy ``f``."""
        below = path.removesuffix(self.suffix) + "/"
        if isinstance(f, EqualTo):
            return f.value == path or str(f.value).startswith(below)
        if isinstance(f, In):
            return any(x == path or str(x).startswith(below) for x in f.value)
        if isinstance(f, StringStartsWith):
            return path.startswith(f.value) or below.startswith(f.value) or f.value.startswith(below)
        return True

    def read(self, partition):
        """Record batches of the wanted columns."""
        if partition.value is None:
            return
        members = "".join(f"(?=.*{x})" for x in self.patterns)
        lines = _line_reader(self.batch_rows, self.suffix, rf"(?s)\A{members}" if members else None)
        for batch in lines([pa.RecordBatch.from_pydict({"path": [partition.value]})]):
            yield batch.select(self.columns)


def _pattern(f):
    """What a member's path, after a leading slash that is not its own, must hold, or None."""
    if isinstance(f, EqualTo):
        return rf"(?<=\A/){re.escape(f.value)}\Z"
    if isinstance(f, In):
        return rf"(?<=\A/)(?:{'|'.join(re.escape(x) for x in f.value if x is not None)})\Z"
    if isinstance(f, StringStartsWith):
        return rf"(?<=\A/){re.escape(f.value)}"
    if isinstance(f, StringEndsWith):
        return rf"(?<=.){re.escape(f.value)}\Z"
    if isinstance(f, StringContains):
        return rf"(?<=.){re.escape(f.value)}"
    return None


class ArchiveSource(DataSource):
    """``spark.read.format("log_archives").load(glob)``; options ``suffix``, ``members``, ``batch_rows``."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return LINES

    def reader(self, schema):
        return ArchiveReader(schema, self.options)


def register_archives(spark):
    """Make the format known to a session and let it push filters; gives back the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark


def load_archived(spark, glob, file, suffix=SUFFIX):
    """One kind of log out of all archives through the format, as ``read_archived`` gives it."""
    lines = register_archives(spark).read.format(NAME)
    lines = lines.options(suffix=suffix, members=_member_pattern(file)).load(glob)
    return archived_table(lines, file, suffix)
