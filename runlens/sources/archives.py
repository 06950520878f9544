"""Logs inside ``.tar.gz`` archives, read without unpacking them to disk."""

from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.paths import with_prefix, with_server_fields, with_source_fields
from runlens.operators.clocks import with_deviation
from runlens.sources.logs import typed_transactions

LINES = "archive string, member string, line_no long, line string"
SUFFIX = ".tar.gz"


def _line_reader(batch_rows, suffix, members):
    """The function that turns archives into batches of lines.

    Archives are streamed in blocks, archives within them included, so a task holds a block and a
    batch at a time. It stands alone because it travels to the executors.
    """

    def read(batches):
        import re
        import tarfile

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        block = 4 * 1024 * 1024
        wanted = re.compile(members) if members else None

        def text(lines):
            try:
                return pa.array(lines, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:
                return pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())

        def blocks_of(body):
            """(number of the first line, lines) of each block of a file."""
            number, rest = 1, b""
            while chunk := body.read(block):
                *lines, rest = (rest + chunk).replace(b"\r\n", b"\n").split(b"\n")
                yield number, lines
                number += len(lines)
            if rest:
                yield number, [rest.removesuffix(b"\r")]

        def pieces_of(stream, archive):
            with tarfile.open(fileobj=stream, mode="r|gz") as tar:
                for entry in tar:
                    if not entry.isfile():
                        continue
                    member = entry.name.removeprefix("./")
                    inner = member.endswith(suffix)
                    if wanted and not inner and not wanted.search(f"/{member}"):
                        continue  # passed over in the stream, neither decoded nor sent on
                    body = tar.extractfile(entry)
                    if inner:
                        yield from pieces_of(body, f"{archive.removesuffix(suffix)}/{member}")
                        continue
                    for number, lines in blocks_of(body):
                        if lines:
                            yield [
                                pa.repeat(archive, len(lines)),
                                pa.repeat(member, len(lines)),
                                pa.array(np.arange(number, number + len(lines))),
                                text(lines),
                            ]

        def opened(path):
            if path.startswith("file:/") and not path.startswith("file://"):
                path = "file://" + path[len("file:") :]
            try:
                filesystem, inside = fs.FileSystem.from_uri(path)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as error:
                raise ValueError(f"pyarrow.fs cannot open {path}: {error}") from error
            return filesystem.open_input_stream(inside, compression=None)

        def batch(pieces):
            columns = [pa.concat_arrays(column) for column in zip(*pieces)]
            return pa.RecordBatch.from_arrays(columns, ["archive", "member", "line_no", "line"])

        pieces, rows = [], 0
        for part in batches:
            for path in part.column(0).to_pylist():
                with opened(path) as stream:
                    for piece in pieces_of(stream, path):
                        pieces.append(piece)
                        rows += len(piece[0])
                        if rows >= batch_rows:
                            yield batch(pieces)
                            pieces, rows = [], 0
        if pieces:
            yield batch(pieces)

    return read


def read_archives(spark, glob, suffix=SUFFIX, batch_rows=20000, members=None):
    """The lines of all files in all archives: (archive, member, line_no, line).

    Spark lists the archives and spreads them over the tasks; each is streamed from its path with
    ``pyarrow.fs``, whatever its size, and a scheme that it does not know is an error. A compressed
    archive can only be read from its start, so one archive is one task's work. ``members`` is a
    pattern of the member paths (after a leading ``/``); others are passed over. An archive inside
    an archive is read too, its path being that of the outer one without suffix plus its own.
    """
    files = spark.read.format("binaryFile").load(glob).select("path")
    return files.mapInArrow(_line_reader(batch_rows, suffix, members), LINES)


# How to read one kind of log out of the archives: its layout and where its keys come from.
_TABLES = {
    "transactions.csv": (
        schemas.TRANSACTIONS,
        lambda df, path: typed_transactions(with_source_fields(df, path=path)),
    ),
    "summary.csv": (schemas.SUMMARY, with_source_fields),
    "txn_events.csv": (schemas.CLIENT_EVENTS, with_prefix),
    "deadlocks.csv": (schemas.DEADLOCKS, with_prefix),
    "txn_timestamps.csv": (
        schemas.TXN_TIMESTAMPS,
        lambda df, path: with_deviation(with_server_fields(df, path)),
    ),
    "generic.csv": (schemas.MEASUREMENTS, with_prefix),
    "events.csv": (schemas.SERVER_EVENTS, with_prefix),
    "forw_sequ_latency.csv": (
        schemas.LINK_LATENCY,
        lambda df, path: with_source_fields(df, "src", "string", path),
    ),
    "deadlock_resolver.csv": (schemas.RESOLVER, with_prefix),
}


def _member_pattern(file):
    """Matches a log's path, or that of a part in a folder named like it."""
    return rf"/{file.replace('.', '[.]')}(/[^/]+)?$"


def archived_table(lines, file, suffix=SUFFIX):
    """The typed rows of one kind of log (``"transactions.csv"``, ...) among archived lines.

    An archive stands for the directory it would be unpacked to: its path without the suffix.
    Files may also lie in a folder of parts named like the file.
    """
    layout, with_keys = _TABLES[file]
    cut = F.when(F.col("archive").endswith(suffix), F.length("archive") - len(suffix))
    folder = F.substring(F.col("archive"), F.lit(1), F.coalesce(cut, F.length("archive")))
    path = F.concat_ws("/", folder, F.col("member"))
    rows = lines.where(path.rlike(_member_pattern(file)) & (F.col("line_no") > 1))
    parsed = rows.select(path.alias("_path"), F.from_csv("line", F.lit(layout)).alias("_row"))
    return with_keys(parsed.select("_path", "_row.*"), path=F.col("_path")).drop("_path")


def read_archived(spark, glob, file, suffix=SUFFIX, batch_rows=20000):
    """One kind of log out of all archives; members of other kinds are passed over."""
    lines = read_archives(spark, glob, suffix, batch_rows, _member_pattern(file))
    return archived_table(lines, file, suffix)
