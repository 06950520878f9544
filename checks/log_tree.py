"""Scaffolding for the reader checks: a log tree and archives written from a view by Spark."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from runlens.sources.store import scratch_dir


def _uri(path):
    """A path as ``pyarrow.fs`` wants it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:") :]
    return path


def _helpers():
    """Functions of the writers, defined inside so that they travel to tasks that lack this module."""

    def directories(batches):
        """(experiment, directory, rows) of the runs of equal directories in sorted batches."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            found = pa.Table.from_batches([batch])
            changes = np.zeros(found.num_rows - 1, bool)
            for name in ("_experiment", "_directory"):
                key = found[name].combine_chunks()
                changes |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(changes) + 1), found.num_rows]
            for low, high in zip(ends, ends[1:]):
                rows = found.slice(low, high - low)
                yield str(rows["_experiment"][0]), str(rows["_directory"][0]), rows

    def lines(rows, columns, header):
        """Rows as lines of CSV; texts are quoted, nulls are nothing."""
        import io

        from pyarrow import csv

        out = io.BytesIO()
        if header:
            out.write((",".join(columns) + "\n").encode())
        csv.write_csv(rows.select(columns), out, csv.WriteOptions(include_header=False))
        return out.getvalue()

    return directories, lines


def _file_writer(root, side, file, columns):
    """Write the rows of each (experiment, directory) of a task to a file of its own.

    The rows come sorted by directory, so one file is open at a time.
    """
    directories, lines = _helpers()

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        filesystem, base = fs.FileSystem.from_uri(root)
        part = TaskContext.get().partitionId()
        path, out, rows = None, None, 0
        for experiment, directory, group in directories(batches):
            rows += group.num_rows
            folder = f"{base}/{experiment}/{side}/{directory}/{file}"
            first = path != f"{folder}/part-{part:05d}.csv"
            if first:
                if out:
                    out.close()
                filesystem.create_dir(folder, recursive=True)
                path = f"{folder}/part-{part:05d}.csv"
                out = filesystem.open_output_stream(path)
            out.write(lines(group, columns, first))
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    return write


def _archive_writer(root, side, file, columns):
    """Write the rows of each experiment of a task to an archive of its own."""
    directories, lines = _helpers()

    def write(batches):
        import io
        import tarfile

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        filesystem, base = fs.FileSystem.from_uri(root)
        part = TaskContext.get().partitionId()
        current, out, tar, rows = None, None, None, 0
        for number, (experiment, directory, group) in enumerate(directories(batches)):
            rows += group.num_rows
            if experiment != current:
                if tar:
                    tar.close()
                    out.close()
                filesystem.create_dir(f"{base}/{experiment}", recursive=True)
                out = filesystem.open_output_stream(
                    f"{base}/{experiment}/p{part}.tar.gz", compression=None
                )
                tar = tarfile.open(fileobj=out, mode="w|gz")
                current = experiment
            data = lines(group, columns, True)
            entry = tarfile.TarInfo(f"{side}/{directory}/{file}/part-{number:05d}.csv")
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
        if tar:
            tar.close()
            out.close()
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    return write


_SALTS = 64  # how many pieces a directory has at most


def write_tree(df, side, file, columns, archives=False, root=None):
    """Write ``df`` (with ``_experiment`` and ``_directory``) as logs; return the root.

    Rows of one directory lie together, yet a heavy directory is spread over several tasks. They are
    dealt by hashes, since a shuffle by range would compute ``df`` twice, once to sample it.
    """
    root = root or _uri(f"{scratch_dir(df.sparkSession)}/tree-{uuid.uuid4().hex}")
    writer = (_archive_writer if archives else _file_writer)(root, side, file, columns)
    by = ["_experiment", "_directory"]
    salt = F.pmod(F.xxhash64(*columns), F.lit(_SALTS))
    # A tree has no place for rows without an experiment or a directory.
    texts = [f.name for f in df.schema.fields if f.name in columns and f.dataType == StringType()]
    kept = df.dropna(subset=by).withColumns({c: F.nullif(c, F.lit("")) for c in texts})
    placed = kept.repartition(*by, salt).sortWithinPartitions(*by)
    placed.mapInArrow(writer, "rows long").agg({"rows": "sum"}).collect()
    return root
