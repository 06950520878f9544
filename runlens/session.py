"""A session with the settings that the operators are written for."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Else a join whose partitioning serves the aggregate after it would not be split.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(app="runlens", master=None, **settings):
    """Return a session with adaptive execution on.

    On a cluster set ``spark.sql.shuffle.partitions`` for the largest shuffle (about 200 MB a
    partition); adaptive execution merges the small ones. ``spark.checkpoint.dir`` must name a
    folder that all executors share.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
