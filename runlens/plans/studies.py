"""Whole studies: from the logs of many experiments to a result table, one job per table.

``logs`` is a ``RunLogs``. Settings such as ``clients=3000`` pick experiments by their metadata;
their logs alone are read on.
"""

from pyspark.sql import functions as F

from runlens.functions.columns import multi_home, single_home
from runlens.operators import deadlocks as dl
from runlens.operators import events as ev
from runlens.operators import latency as lat
from runlens.operators import reports as rep
from runlens.operators.facts import as_list, with_metadata
from runlens.operators.sampling import sample_rows
from runlens.operators.stats import DEFAULT_ACCURACY, cdf, shift_to_zero
from runlens.operators.throughput import (
    counter_throughput,
    event_throughput,
    throughput,
    throughput_over_time,
    with_index,
)
from runlens.sources.store import settle

FOUR = (0.5, 0.9, 0.95, 0.99)


def _of(rows, index, settings):
    """The rows of the chosen experiments; all of them if nothing was chosen."""
    if not settings:
        return rows
    return with_metadata(rows, index.select("prefix"), how="left_semi", stored=True)


def throughput_study(logs, start_s=10, dur_s=50, order=("prefix",), **settings):
    """Throughput of the experiments with their metadata."""
    index = logs.experiments(**settings)
    rows = _of(logs.transactions, index, settings)
    rates = throughput(rows, logs.summary, start_s=start_s, dur_s=dur_s)
    return with_index(rates, index).orderBy(*as_list(order))


def latency_study(
    logs,
    homes="all",
    probs=FOUR,
    order=("prefix",),
    contains=None,
    window=None,
    method="approx",
    accuracy=DEFAULT_ACCURACY,
    fixed=False,
    **settings,
):
    """Latency percentiles of the experiments with their metadata.

    ``homes`` is ``"all"``, ``"single"``, or ``"multi"`` for multi-home transactions with regions
    weighted alike, of which ``fixed`` takes the same number in each region. ``contains`` restricts
    the experiment names; ``method`` and ``accuracy`` are those of ``percentiles``. Exact percentiles
    of all transactions start from the counts in the logs' store, if they have one.
    """
    if homes not in ("all", "single", "multi"):
        raise ValueError("homes must be 'all', 'single' or 'multi'")
    how = {"method": method, "accuracy": accuracy}
    index = logs.experiments(**settings)
    if contains is not None:
        index = lat.named(index, contains, depth=logs.depth)
    rows = _of(logs.transactions, index, settings or contains)
    rows = lat.latency(rows, **(window or {}))
    if homes == "single":
        found = lat.single_home_percentiles(rows, index, probs=probs, **how)
    elif homes == "multi":
        # Ids repeat between experiments, draws shall not; nor shall they depend on the root.
        key = ["experiment", "txn_id"]
        rows = logs.with_experiment(rows)
        found = lat.stratified_percentiles(rows, index, key=key, probs=probs, fixed=fixed, **how)
    else:
        bins = logs.latency_bins if method == "exact" and not window else None
        if bins is not None:
            bins = _of(bins, index, settings or contains)
        found = lat.latency_percentiles(rows, probs=probs, bins=bins, **how).join(index, "prefix")
    return found.orderBy(*as_list(order))


def deadlock_study(logs, region=0, **settings):
    """Number and sizes of deadlocks per configuration and share of multi-home transactions."""
    index = logs.experiments(**settings)
    found = dl.deadlock_profile(logs.deadlocks, index, logs.summary, region=region, stored=True)
    return found.orderBy("config_name", "wl_mh")


def deadlock_totals_study(logs, tag, region=0, **settings):
    """Number and total size of deadlocks per experiment, in the order of a tag."""
    index = logs.experiments(**settings)
    totals = dl.deadlock_totals(_of(logs.deadlocks, index, settings), index, region=region)
    return totals.join(index.select("prefix", tag), "prefix").orderBy(tag)


def regional_latency(logs, shifts=None, condition=None):
    """Latencies with metadata and the coordinator's region."""
    return lat.latency_by_region(
        lat.latency(logs.transactions), logs.index, shifts, condition, stored=True
    )


def latency_cdfs(latencies, settings, split=()):
    """The distribution of latency per coordinator region for chosen settings.

    ``settings`` maps a configuration to its client count. Configurations in ``split`` have
    single-home and multi-home curves, the others one curve.
    """
    chosen = None
    for config, clients in settings.items():
        match = (F.col("config_name") == config) & (F.col("clients") == clients)
        chosen = match if chosen is None else chosen | match
    divided = F.col("config_name").isin(list(split))
    homes = (
        F.when(divided & single_home(), "single")
        .when(divided & multi_home(), "multi")
        .otherwise("all")
    )
    rows = latencies.where(chosen).withColumn("homes", homes)
    return cdf(rows, ["config_name", "homes", "coordinator_region"], "latency")


def throughput_latency_study(
    logs, shifts=None, start_s=5, dur_s=20, method="approx", accuracy=DEFAULT_ACCURACY, **settings
):
    """Throughput against latency percentiles per configuration and client count.

    ``method`` and ``accuracy`` are those of ``percentiles``.
    """
    rates = throughput_study(logs, start_s, dur_s, **settings)
    index = logs.experiments(**settings)
    rows = _of(logs.transactions, index, settings)
    latencies = lat.latency_by_region(lat.latency(rows), index, shifts, stored=True)
    bins = logs.latency_bins if method == "exact" else None
    if bins is not None:
        bins = with_metadata(bins, index, stored=True)
    return lat.throughput_latency_curve(rates, latencies, FOUR, accuracy, method, bins)


def rate_study(logs, **settings):
    """Throughput over time of the experiments, each with its times shifted to 0."""
    index = logs.experiments(**settings)
    rows = _of(logs.transactions, index, settings)
    rates = throughput_over_time(rows, logs.summary)
    return shift_to_zero(settle(rates, "rates"), "prefix", "time").orderBy("prefix", "time")


def event_rate_study(logs, sample=100, per_machine=False):
    """Events per second at the servers, each experiment with its times shifted to 0."""
    rates = event_throughput(logs.server_events, sample, per_machine)
    return shift_to_zero(settle(rates, "rates"), "prefix", "time").orderBy("prefix", "time")


def scalability_study(logs, pattern=r"sz(\d+)"):
    """Throughput from the clients' counters against the cluster size in the experiment name."""
    rates = counter_throughput(logs.summary, scale_pattern=pattern)
    return with_index(rates, logs.index).orderBy("scale")


def graph_study(logs, name, t0, t1):
    """Sizes of the dependency graph in one experiment over a time range, in time order."""
    rows = logs.resolver.where(F.col("prefix").endswith("/" + name))
    return dl.graph_size_series(rows, t0, t1).orderBy("time")


def comparison_study(logs, report, configs, name, base_hot=1000000, window=None):
    """Throughput of our configurations next to another system's report: absolute and relative.

    Returns (absolute, relative to the row with ``wl_hot`` = ``base_hot`` of the same share).
    """
    ours = throughput_study(logs, **(window or {}))
    both = rep.compare_systems(ours, rep.report_throughput(report, name), configs)
    columns = [*configs, name]
    return both, rep.relative_to(both, "wl_mh", F.col("wl_hot") == base_hot, columns)


def scaled_comparison(logs, report, config, name, mh_values, window=None):
    """Throughput over the largest of each system, per contention and share of multi-home."""
    ours = throughput_study(logs, **(window or {}), config_name=config)
    ours = ours.select("wl_mh", "wl_hot", F.col("throughput").alias(config))
    scaled = rep.scale_by_max_wide(ours, config, mh_values)
    theirs = rep.scale_by_max_wide(rep.report_throughput(report, name), name, mh_values)
    return scaled.join(theirs, "hot", "left").orderBy("hot")


def latency_comparison(logs, report, name, **options):
    """Latency percentiles of our experiments and of another system's report, stacked."""
    ours = latency_study(logs, probs=(0.5, 0.95, 0.99), **options)
    return rep.stack_systems(ours, rep.report_latency(report, name))


def breakdown_study(
    logs,
    start,
    end,
    name=None,
    by_home=True,
    by_machine=True,
    fraction=1.0,
    key=("experiment", "txn_id"),
):
    """Time between two events of the transactions of all experiments (or of one ``name``).

    A ``fraction`` draws whole transactions, each experiment its own.
    """
    events, txns = logs.client_events, logs.transactions
    if name is not None:
        in_run = F.col("prefix").endswith("/" + name)
        events, txns = events.where(in_run), txns.where(in_run)
    diffs = ev.event_diff(events, txns, start, end, by_home, by_machine)
    if fraction >= 1.0:
        return diffs
    return sample_rows(logs.with_experiment(diffs), fraction, key).drop("experiment")


def breakdowns_study(
    logs,
    pairs,
    names=None,
    by_home=True,
    by_machine=True,
    fraction=1.0,
    key=("experiment", "txn_id"),
    **settings,
):
    """Time between many pairs of events, of all experiments or those of ``names``, in one job.

    One row per transaction, home, machine and ``pair``, with the transaction's facts and the name
    of its ``experiment``; ``pairs`` as in ``event_pairs``. A ``fraction`` draws whole
    transactions, each experiment its own, before they are moved.
    """
    events = logs.with_experiment(logs.client_events)
    txns = logs.transactions
    if names is not None:
        events = events.where(F.col("experiment").isin(as_list(names)))
        txns = logs.with_experiment(txns).where(F.col("experiment").isin(as_list(names)))
        txns = txns.drop("experiment")
    if settings:
        index = logs.experiments(**settings)
        events, txns = _of(events, index, settings), _of(txns, index, settings)
    if fraction < 1.0:
        events = sample_rows(events, fraction, key)
    by = ["home"] * by_home + ["machine"] * by_machine
    found = ev.event_pairs(events.drop("experiment"), pairs, txns, by)
    return logs.with_experiment(found)


def breakdown_cdfs(diffs, keys=("prefix",)):
    """The distribution of the time between two events, per ``keys``."""
    return cdf(diffs, as_list(keys), "diff")
