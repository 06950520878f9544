"""Column layouts of the log files, as Spark's readers take them.

CSV columns bind by position, so the order of the fields is the order in the files. The readers
cannot make a column non-null, so every field is nullable.
"""

# The columns of the log files and reports, in the order of the files.
TRANSACTIONS = (
    "txn_id long, coordinator int, regions string, partitions string, generator long, "
    "restarts int, global_log_pos string, sent_at double, received_at double"
)
SUMMARY = (
    "committed long, aborted long, not_started long, restarted long, single_home long, "
    "multi_home long, single_partition long, multi_partition long, remaster long, "
    "elapsed_time long"
)
DEADLOCKS = "time long, partition int, region int, vertices int"
TXN_TIMESTAMPS = "txn_id long, `from` int, txn_timestamp long, server_time long"
MEASUREMENTS = "type int, time long, data long, partition int, region int"
LEGACY_MEASUREMENTS = "type long, time long, data long, partition int, replica int"
CLIENT_EVENTS = "txn_id long, event string, time double, machine int, home int"
SERVER_EVENTS = "txn_id long, event string, time double, partition int, region int"
LINK_LATENCY = "dst int, send_time long, recv_time long, avg_latency long"
RESOLVER = (
    "time long, partition int, region int, runtime long, unstable_graph_sz int, "
    "stable_graph_sz int, deadlocks_resolved int, graph_update_time int"
)
REPORT = (
    "wl_mh int, wl_hot int, region string, type string, count int, throughput double, "
    "avg double, p50 double, p95 double, p99 double, pMax double"
)
LATENCY_REPORT = (
    "wl_mh int, wl_hot int, region string, throughput double, avg double, p50 double, "
    "p95 double, p99 double, pMax double"
)

# How many low bits of a coordinator id lie below its region, by configuration.
REGION_SHIFT = {
    "calvin.conf": 16,
    "calvin_paxos.conf": 16,
    "janus.conf": 24,
    "baseline.conf": 24,
}

# The metadata columns that hold whole numbers.
METADATA_INTS = ["duration", "txns", "clients", "rate", "sample", "wl_hot", "wl_mh", "wl_mp"]


def names(layout):
    """The column names of a layout."""
    return [field.split()[0].strip("`") for field in layout.split(",")]
