"""Stored results: the result cache (S14) and short-lived tables in the shared folder."""

import json
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_SETTLED = []  # the paths that the innermost ``scratch`` block has to delete


def _hadoop_path(spark, path):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, path):
    jpath, fs = _hadoop_path(spark, path)
    return fs.exists(jpath)


def delete(spark, path):
    """Delete a file or folder, if it is there."""
    jpath, fs = _hadoop_path(spark, path)
    return fs.delete(jpath, True)


def files_below(spark, path):
    """The names of the files in a folder; none if there is no such folder."""
    jpath, fs = _hadoop_path(spark, path)
    if not fs.exists(jpath):
        return set()
    return {status.getPath().getName() for status in fs.listStatus(jpath)}


def write_schema(rows, path):
    """Keep the schema beside the rows, since an empty table has no file that knows it."""
    kept = rows.sparkSession.createDataFrame([(rows.schema.json(),)], "value string")
    kept.coalesce(1).write.mode("overwrite").text(f"{path}/_schema")


def scratch_dir(spark):
    """The folder for short-lived tables, below the checkpoint folder the cluster names.

    Only a local session without the setting gets a folder of its own, since no other machine
    has to read it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="runlens-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/runlens-{context.applicationId}"


def settle(df, name="table", packed=False):
    """Write ``df`` to the scratch folder and read it back.

    This cuts the lineage, freezes values that depend on the partitioning, and gives the planner
    the real size of the table: a small one is broadcast in later joins because its files are
    below ``spark.sql.autoBroadcastJoinThreshold``, a large one is sort-merge joined. The files
    are neither compressed nor encoded, so that their size is about that in memory; tables that
    only pass data on are ``packed``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if not packed:
        writer = writer.option("compression", "none").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    if _SETTLED:
        _SETTLED[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark):
    """Delete the tables that are settled inside the ``with`` block when it ends.

    Results have to be consumed (written, collected) inside the block.
    """
    _SETTLED.append([])
    try:
        yield
    finally:
        for path in _SETTLED.pop():
            delete(spark, path)


def clear_scratch(spark):
    """Delete the tables this application settled; call it when their results are consumed."""
    return delete(spark, scratch_dir(spark))


def materialize(spark, path, build, refresh=False, partition_by=None):
    """Return the result stored at ``path``; compute and store it if it is not there.

    ``build`` is a function without arguments that returns a DataFrame. A store counts only once
    its commit marker is there, so a broken write is computed again. ``partition_by`` lays the
    rows out by a column without moving them between tasks, which suits rows that lie together
    already, as those of an experiment do in its log files.
    """
    if refresh or not all(exists(spark, f"{path}/{x}_SUCCESS") for x in ("", "_schema/")):
        result: DataFrame = build()
        writer = result.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        write_schema(result, path)
    schema = json.loads(spark.read.text(f"{path}/_schema").first()[0])
    return spark.read.schema(StructType.fromJson(schema)).parquet(path)
