"""How long transactions take."""

from pyspark.sql import functions as F

from runlens.functions.columns import (
    coordinator_region,
    ms_between,
    multi_home,
    packed_region,
    single_home,
)
from runlens.functions.paths import experiment_name
from runlens.operators.facts import as_list, with_metadata
from runlens.operators.sampling import fixed_sample, sample_rows, stratified_sample
from runlens.operators.stats import DEFAULT_ACCURACY, percentiles, value_bins
from runlens.operators.window import run_window


def latency(txns, fraction=1.0, seed=0, key=None, keep=(), **window):
    """M8: the latency of each transaction in ms, for all experiments in one scan.

    ``window`` takes the arguments of ``run_window``; ``fraction`` below 1 samples the rows.
    """
    rows = run_window(txns, **window).select(
        "prefix",
        "txn_id",
        "coordinator",
        "regions",
        "partitions",
        *as_list(keep),
        ms_between("sent_at", "received_at").alias("latency"),
    )
    return rows if fraction >= 1.0 else sample_rows(rows, fraction, key, seed)


def named(df, text, name="prefix", depth=1):
    """The rows of the experiments whose name contains ``text``, whatever their root.

    That the path contains it reaches the scan; that it is not the root is checked on what is left.
    """
    return df.where(F.col(name).contains(text) & experiment_name(name, depth).contains(text))


def latency_percentiles(
    latencies, keys="prefix", probs=(0.5, 0.99), accuracy=DEFAULT_ACCURACY, method="approx", bins=None
):
    """M9 on latencies; ``bins`` as in ``percentiles``."""
    return percentiles(latencies, keys, "latency", probs, accuracy, method=method, bins=bins)


def latency_bins(txns, keys=("prefix", "machine")):
    """Counts of all latencies per bin, for exact percentiles of any roll-up of ``keys``."""
    rows = latency(txns, keep=[k for k in as_list(keys) if k != "prefix"])
    return value_bins(rows, as_list(keys), "latency")


def single_home_percentiles(latencies, index, **options):
    """Percentiles of the single-home transactions per experiment, with metadata."""
    found = latency_percentiles(latencies.where(single_home()), **options)
    return found.join(index, "prefix")


def stratified_percentiles(
    latencies, index=None, n=200, key=None, seed=1000, shift=24, fixed=False, **options
):
    """Percentiles of the multi-home transactions per experiment, regions weighted alike.

    Each (experiment, coordinator region) is thinned to about ``n`` transactions first, or to
    exactly ``n`` if ``fixed`` (with a ``key``). Use a key that does not hold the logs' root, so
    that copies of a tree give the same: ``experiment_name`` next to the transaction's id.
    """
    rows = latencies.where(multi_home()).select(
        "prefix",
        "latency",
        packed_region("coordinator", shift).alias("region"),
        *[k for k in as_list(key) if k not in ("prefix", "latency")],
    )
    thinned = fixed_sample if fixed else stratified_sample
    even = thinned(rows, ["prefix", "region"], n, key, seed)
    found = latency_percentiles(even, **options)
    return found if index is None else found.join(index, "prefix")


def latency_by_region(latencies, index, shifts=None, condition=None, stored=False):
    """Latencies with the metadata of their experiment and the coordinator's region.

    ``condition`` restricts the experiments (say one configuration and client count) before the
    join; ``stored`` says that the index is a stored table already.
    """
    rows = with_metadata(latencies, index, condition, stored=stored)
    return coordinator_region(rows, shifts)


def throughput_latency_curve(
    throughputs,
    latencies,
    probs=(0.5, 0.9, 0.95, 0.99),
    accuracy=DEFAULT_ACCURACY,
    method="approx",
    bins=None,
):
    """Throughput next to latency percentiles per configuration and client count.

    Both inputs carry ``config_name`` and ``clients``; ``latencies`` is a result of
    ``latency_by_region``. ``bins`` as in ``percentiles``.
    """
    by = ["config_name", "clients"]
    found = percentiles(latencies, by, "latency", probs, accuracy, method=method, bins=bins)
    return (
        throughputs.select(*by, "throughput")
        .join(found, by)
        .orderBy("config_name", "throughput")
    )
