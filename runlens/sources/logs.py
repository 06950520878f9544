"""Readers of the per-machine logs of all experiments below a root.

A log lies at ``{root}/{experiment}/client/{machine}/{file}`` or
``{root}/{experiment}/server/{region}-{partition}/{file}``. ``experiment`` may be a glob or a list
of names; every reader covers all matching experiments in one scan and tags the rows with their
``prefix``.

Columns bind by position and headers are not compared with the layout, so logs with renamed
columns can be read; ``check_header=True`` makes Spark compare them.
"""

import re

from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.columns import parse_id_list
from runlens.functions.paths import with_prefix, with_server_fields, with_source_fields
from runlens.operators.clocks import with_deviation


def scan(spark, path, schema, check_header=False):
    """A CSV scan with a header line and a fixed layout."""
    reader = spark.read.schema(schema).option("header", True)
    return reader.option("enforceSchema", not check_header).csv(path)


#: The side and the file of each log.
FILES = {
    "transactions": ("client", "transactions.csv"),
    "summary": ("client", "summary.csv"),
    "deadlocks": ("server", "deadlocks.csv"),
    "txn_timestamps": ("server", "txn_timestamps.csv"),
    "measurements": ("server", "generic.csv"),
    "client_events": ("client", "txn_events.csv"),
    "server_events": ("server", "events.csv"),
    "link_latency": ("server", "forw_sequ_latency.csv"),
    "resolver": ("server", "deadlock_resolver.csv"),
}


def literal(name):
    """A path that a glob matches as it is."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def log_paths(root, experiment, side, directory, file):
    """The glob of a log; ``experiment`` is a glob, or a list of the names of experiments."""
    if isinstance(experiment, (list, tuple)):
        return [f"{root}/{literal(name)}/{side}/{directory}/{file}" for name in experiment]
    return f"{root}/{experiment}/{side}/{directory}/{file}"


def client_path(root, experiment, file, machine="*"):
    return log_paths(root, experiment, "client", machine, file)


def server_path(root, experiment, file, server="*"):
    return log_paths(root, experiment, "server", server, file)


def typed_transactions(df):
    """The list columns of raw transaction rows as arrays; regions and partitions sorted."""
    return df.withColumns(
        {
            "regions": parse_id_list("regions"),
            "partitions": parse_id_list("partitions"),
            "global_log_pos": parse_id_list("global_log_pos", sort=False),
        }
    )


def read_transactions(spark, root, experiment="*", check_header=False):
    """Sampled transactions with the client machine that sent them."""
    path = client_path(root, experiment, "transactions.csv")
    raw = scan(spark, path, schemas.TRANSACTIONS, check_header)
    return typed_transactions(with_source_fields(raw))


def read_summary(spark, root, experiment="*", check_header=False):
    """The counters of each client."""
    path = client_path(root, experiment, "summary.csv")
    return with_source_fields(scan(spark, path, schemas.SUMMARY, check_header))


def read_deadlocks(spark, root, experiment="*", region_col="region", check_header=False):
    """S3: resolved deadlocks; old logs call the region ``replica``."""
    fields = schemas.DEADLOCKS
    if region_col != "region":
        fields = f"time long, partition int, `{region_col}` int, vertices int"
    path = server_path(root, experiment, "deadlocks.csv")
    return with_prefix(scan(spark, path, fields, check_header))


def read_txn_timestamps(spark, root, experiment="*", check_header=False):
    """Assigned timestamps against the server clock, ``dev`` in ms, with the server."""
    path = server_path(root, experiment, "txn_timestamps.csv")
    raw = scan(spark, path, schemas.TXN_TIMESTAMPS, check_header)
    return with_deviation(with_server_fields(raw))


def read_measurements(
    spark, root, experiment="*", legacy=False, kind=None, server=None, check_header=False
):
    """Measured points (type, time, data); ``kind`` keeps one type.

    Legacy logs are read from server 0-0, name the region ``replica`` and hold nanoseconds, which
    become ms.
    """
    layout = schemas.LEGACY_MEASUREMENTS if legacy else schemas.MEASUREMENTS
    path = server_path(root, experiment, "generic.csv", server or ("0-0" if legacy else "*"))
    points = with_prefix(scan(spark, path, layout, check_header))
    if legacy:
        points = points.withColumn("data", F.col("data") / 1000000)
    return points if kind is None else points.where(F.col("type") == kind)


def read_client_events(spark, root, experiment="*", check_header=False):
    """Event times of transactions, collected at the clients."""
    path = client_path(root, experiment, "txn_events.csv")
    return with_prefix(scan(spark, path, schemas.CLIENT_EVENTS, check_header))


def read_server_events(spark, root, experiment="*", check_header=False):
    """Event times of transactions at the servers."""
    path = server_path(root, experiment, "events.csv")
    return with_prefix(scan(spark, path, schemas.SERVER_EVENTS, check_header))


def read_link_latency(spark, root, experiment="*", check_header=False):
    """Send and receive times between servers; ``src`` is the server's directory."""
    path = server_path(root, experiment, "forw_sequ_latency.csv")
    return with_source_fields(
        scan(spark, path, schemas.LINK_LATENCY, check_header), "src", "string"
    )


def read_resolver(spark, root, experiment="*", server="0-0", check_header=False):
    """Runs of the deadlock resolver with the sizes of the dependency graph."""
    path = server_path(root, experiment, "deadlock_resolver.csv", server)
    return with_prefix(scan(spark, path, schemas.RESOLVER, check_header))
