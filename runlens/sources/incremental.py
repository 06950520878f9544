"""Stored copies of logs that follow their sources, one experiment at a time.

Beside the rows lies a manifest: the experiments that the copy was made from, each with a signature
of its source files (path, length, time of change). A later call lists the files, compares, and
rebuilds only what is new or changed; what is gone is dropped. The manifest is written last, so a
call that breaks off is made good by the next one.
"""

import json
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlens.functions.paths import prefix_of
from runlens.sources.store import delete, exists, files_below, materialize, write_schema

_KEY = "prefix"


@contextmanager
def _setting(spark, name, value):
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def source_files(spark, paths):
    """(prefix, path, length, modified) of the files that the globs match; none are opened."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths)
    path = F.col("_metadata.file_path")  # spelled as in the rows of the logs
    return files.select(
        prefix_of(path).alias(_KEY),
        path.alias("path"),
        "length",
        F.unix_micros("modificationTime").alias("modified"),
    )


def signatures(files):
    """(prefix, n_files, signature): equal exactly if no file was added, removed or changed."""
    one = F.md5(F.concat_ws("|", "path", "length", "modified"))
    return files.groupBy(_KEY).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.md5(F.concat_ws("", F.sort_array(F.collect_list(one)))).alias("signature"),
    )


def _current(spark, paths):
    # Files are only listed, so many of them fit a task, however large they are.
    with _setting(spark, "spark.sql.files.maxPartitionBytes", str(1 << 60)):
        return _table(signatures(source_files(spark, paths)).toArrow())


def differences(now, then):
    """(changed, gone): experiments that are new or differ, and those that are no more."""
    changed = [key for key, value in now.items() if then.get(key) != value]
    return sorted(changed), sorted(set(then) - set(now))


def _table(rows):
    return dict(zip(rows.column(_KEY).to_pylist(), rows.column("signature").to_pylist()))


def _write_manifest(spark, path, now):
    rows = spark.createDataFrame(list(now.items()), "prefix string, signature string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")


def _partition(spark, path, prefix):
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"{path}/{utils.getPartitionPathString(_KEY, prefix)}"


def _read(spark, path):
    schema = json.loads(spark.read.text(f"{path}/_schema").first()[0])
    return spark.read.schema(StructType.fromJson(schema)).parquet(path)


def _in_order(rows, order):
    """Rows laid out by experiment and then ``order``, each file a range of it."""
    if order is None:
        return rows
    return rows.repartitionByRange(_KEY, order).sortWithinPartitions(_KEY, order)


def _rebuild(spark, path, rows, old):
    """Write the rows over their experiments; drop the ``old`` ones that have no rows any more."""
    before = {prefix: files_below(spark, _partition(spark, path, prefix)) for prefix in old}
    # Only the folders of experiments with new rows are replaced.
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(_KEY).parquet(path)
    for prefix, files in before.items():
        folder = _partition(spark, path, prefix)
        if files and files_below(spark, folder) == files:
            delete(spark, folder)


def synced(spark, path, paths, build, refresh=False, order=None):
    """The stored rows at ``path`` of the logs that ``paths`` match, brought up to date.

    ``build(prefixes)`` gives the rows of these experiments, or of all for None; rows carry their
    ``prefix``, by which they are laid out. ``order`` names a column (a time) that they are sorted
    by inside an experiment, in a shuffle by range: a filter on it then passes over most row groups,
    and a heavy experiment has several files. ``refresh`` rebuilds all. The names of changed
    experiments come to the driver, as a listing of their files does in any scan of them.

    As with any overwritten folder, what was planned on rows that are replaced fails, and a query
    planned in that moment may miss the experiment; a root without any log is an error.
    """
    now = _current(spark, paths)
    marks = [f"{path}/{x}_SUCCESS" for x in ("", "_schema/", "_manifest/")]
    if refresh or not all(exists(spark, mark) for mark in marks):
        delete(spark, f"{path}/_manifest")
        rows = build(None)
        writer = _in_order(rows, order).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "static").partitionBy(_KEY).parquet(path)
        write_schema(rows, path)
        changed, gone = [], []
        stale = True
    else:
        then = _table(spark.read.parquet(f"{path}/_manifest").toArrow())
        changed, gone = differences(now, then)
        stale = bool(changed or gone)
        if changed:
            rows = _in_order(build(None if len(changed) == len(now) else changed), order)
            kept = set(then) - set(gone)
            _rebuild(spark, path, rows.select(*_read(spark, path).columns), kept & set(changed))
        for prefix in gone:
            delete(spark, _partition(spark, path, prefix))
    if stale:
        _write_manifest(spark, path, now)
    return _read(spark, path)


def followed(spark, path, paths, build, refresh=False, keep=materialize):
    """The result of ``build()`` stored at ``path``, made again when a file of ``paths`` changed.

    For results that are not laid out by experiment, such as the index. ``keep`` stores it.
    """
    now = _current(spark, paths)
    manifest = f"{path}/_manifest"
    kept = exists(spark, f"{manifest}/_SUCCESS") and not refresh
    same = kept and _table(spark.read.parquet(manifest).toArrow()) == now
    if not same:
        delete(spark, manifest)
    rows = keep(spark, path, build, refresh=not same)
    if not same:
        _write_manifest(spark, path, now)
    return rows
