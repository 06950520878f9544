"""M1 to M7: how many transactions and events per second."""

from pyspark.sql import functions as F

from runlens.functions.paths import tag_from_name
from runlens.operators.facts import as_list, run_keys, with_metadata
from runlens.operators.window import FOREVER_S, machine_spans, run_window, trims
from runlens.sources.store import settle


def committed(summary, keys="prefix"):
    """M1: committed transactions per experiment."""
    return summary.groupBy(*as_list(keys)).agg(F.sum("committed").alias("committed"))


def _rate(sent, summary, keys):
    """The sampling rate from the rows sent per key."""
    return sent.join(committed(summary, keys), keys).select(
        *keys,
        "sent",
        "committed",
        (F.try_divide("sent", "committed") * 100).alias("sample"),
    )


def sample_rate(txns, summary, keys="prefix"):
    """M2: logged transactions as a percentage of the committed ones, over the whole run."""
    keys = as_list(keys)
    sent = txns.groupBy(*keys).agg(F.count("sent_at").alias("sent"))
    return _rate(sent, summary, keys)


def throughput(
    txns,
    summary,
    start_s=0,
    dur_s=FOREVER_S,
    upper="from_end",
    per_machine=False,
    keys="prefix",
    machine="machine",
):
    """M3: transactions per second of each experiment, corrected for sampling.

    The rate of a machine is its transactions in the window over the time between the first and
    the last of them; the experiment's is the sum. The sampling rate is that of the whole run. A
    machine with a single transaction has no rate (null).

    One small aggregate per machine, stored, serves the window bounds, the sampling rate and, if
    the window drops nothing, the rates as well.
    """
    keys = as_list(keys)
    by = [*keys, machine]
    spans = kept = settle(machine_spans(txns, by), "spans")
    if trims(start_s, dur_s, upper):
        rows = txns.select(*by, "sent_at")
        kept = machine_spans(run_window(rows, by, start_s, dur_s, upper, spans=spans), by)
    sample = _rate(spans.groupBy(*keys).agg(F.sum("sent").alias("sent")), summary, keys)
    rate = F.try_divide(
        F.col("sent") * 1000000000 * F.try_divide(F.lit(100), F.col("sample")),
        F.col("last_at") - F.col("first_at"),
    )
    rates = (
        kept.join(sample.select(*keys, "sample"), keys, "left")
        .where(F.col("sent") > 0)
        .select(*by, rate.alias("throughput"))
    )
    if per_machine:
        return rates
    return rates.groupBy(*keys).agg(F.sum("throughput").alias("throughput"))


def with_index(df, index, keys="prefix"):
    """Metadata of the experiment on each row of a result."""
    return df.join(index, as_list(keys))


def throughput_by_experiment(txns, summary, index, clients=None, **window):
    """M4: M3 for all experiments in one job, with their metadata.

    ``clients`` keeps the experiments with that number of clients.
    """
    if clients is not None:
        chosen = F.col("clients") == clients
        index = settle(index, "index")
        txns = with_metadata(txns, index, chosen, "left_semi", stored=True)
        index = index.where(chosen)
    return with_index(throughput(txns, summary, **window), index)


def counter_throughput(summary, keys="prefix", scale_pattern=r"sz(\d+)"):
    """M5: throughput from the clients' counters, and the cluster size in the experiment name."""
    keys = as_list(keys)
    per_second = F.try_divide("committed", "elapsed_time") * 1000000000
    total = summary.groupBy(*keys).agg(F.sum(per_second).alias("throughput"))
    return tag_from_name(total, "scale", scale_pattern) if scale_pattern else total


def throughput_over_time(txns, summary, keys="prefix"):
    """M6: transactions per second of the run, corrected for sampling, in time order.

    The counts per second also give the sampling rate, so the log is read once.
    """
    keys = as_list(keys)
    second = (F.col("sent_at") / 1000000000).cast("long")
    counts = (
        txns.where(F.col("sent_at").isNotNull())
        .groupBy(*keys, second.alias("time"))
        .agg(F.count("sent_at").alias("sent"))
    )
    counts = settle(counts, "seconds")
    sample = _rate(counts.groupBy(*keys).agg(F.sum("sent").alias("sent")), summary, keys)
    return (
        counts.join(sample.select(*keys, "sample"), keys)
        .select(
            *keys,
            "time",
            (F.col("sent") * F.try_divide(F.lit(100), F.col("sample"))).alias("throughput"),
        )
        .orderBy(*keys, "time")
    )


def event_throughput(events, sample=100, per_machine=False, keys=None):
    """M7: events per second of each kind, scaled up from a sample of ``sample`` percent.

    ``keys`` are the experiment, if the events know it.
    """
    keys = run_keys(events) if keys is None else as_list(keys)
    by = [*keys, "event", "time"]
    if per_machine:
        by += ["partition", "region"]
    return (
        events.withColumn("time", (F.col("time") / 1000000000).cast("long"))
        .groupBy(*by)
        .agg((F.count("txn_id") * (100 / sample)).alias("throughput"))
        .orderBy("time")
    )
