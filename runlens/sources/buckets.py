"""Stored tables dealt into buckets by key, so that joins and sums by that key move no rows."""

import hashlib
import json

from runlens.sources.store import delete, exists


def _fields(schema):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _keys(names):
    return ", ".join(f"`{name}`" for name in names)


def _layout(spark, path):
    marks = [f"{path}/{x}_SUCCESS" for x in ("", "_layout/")]
    if not all(exists(spark, mark) for mark in marks):
        return None
    return json.loads(spark.read.text(f"{path}/_layout").first()[0])


def bucketed(spark, path, build, by, buckets, refresh=False):
    """The rows of ``build()`` stored at ``path`` in ``buckets`` files by the hash of ``by``.

    Two tables with the same ``by`` columns and number of buckets are joined on these columns, and
    grouped by them and any others, without an exchange. Heavy values of one column (an experiment)
    do no harm as long as the columns together (with the transaction) tell rows apart. A table
    that is there with the same layout is read, not built.

    Spark knows buckets from its catalog, so the table is entered there under a name made from the
    path, in each session that uses it; the files and a description of the layout lie at ``path``.
    """
    by = list(by)
    name = f"runlens_{hashlib.md5(path.encode()).hexdigest()[:16]}"
    spark.sql(f"drop table if exists `{name}`")  # the entry; files of a given path stay
    layout = _layout(spark, path)
    if refresh or layout is None or (layout["by"], layout["buckets"]) != (by, buckets):
        delete(spark, path)
        rows = build()
        # One task holds one bucket whole, so each is one file.
        placed = rows.repartition(buckets, *by)
        placed.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option(
            "path", path
        ).saveAsTable(name)
        layout = {"by": by, "buckets": buckets, "fields": _fields(rows.schema)}
        text = spark.createDataFrame([(json.dumps(layout),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/_layout")
    else:
        spark.sql(
            f"create table `{name}` ({layout['fields']}) using parquet "
            f"clustered by ({_keys(by)}) sorted by ({_keys(by)}) into {buckets} buckets "
            f"location '{path}'"
        )
    return spark.table(name)
