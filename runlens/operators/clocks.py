"""How far assigned timestamps lie from the server clock."""

from pyspark.sql import functions as F

from runlens.functions.columns import ms_between
from runlens.operators.facts import as_list, run_keys


def with_deviation(stamps):
    """The deviation ``dev`` of each timestamp in ms."""
    return stamps.withColumn("dev", ms_between("server_time", "txn_timestamp"))


def clock_deviation(stamps, keys=None):
    """The deviation per server: count, mean, smallest and largest.

    ``keys`` are region and partition, with the experiment if the table knows it.
    """
    keys = run_keys(stamps) + ["region", "partition"] if keys is None else as_list(keys)
    return stamps.groupBy(*keys).agg(
        F.count("dev").alias("n"),
        F.avg("dev").alias("mean_dev"),
        F.min("dev").alias("min_dev"),
        F.max("dev").alias("max_dev"),
    )
