"""Summary reports and the comparison of systems."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators.facts import as_list, cell, with_facts
from runlens.sources.store import settle

_WORKLOAD = ["wl_mh", "wl_hot"]
OUTCOMES = ["write", "deadlock", "other"]


def _by_workload(df):
    return df.orderBy(F.col("wl_mh").asc(), F.col("wl_hot").desc())


def report_throughput(report, name="throughput", types=None):
    """Throughput per workload over all regions; ``types`` restricts the outcomes."""
    rows = report if types is None else report.where(F.col("type").isin(list(types)))
    return _by_workload(rows.groupBy(*_WORKLOAD).agg(F.sum("throughput").alias(name)))


def report_latency(report, config_name, probs=("p50", "p95", "p99")):
    """Mean over the regions of each percentile, per workload."""
    means = report.groupBy(*_WORKLOAD).agg(*[F.avg(p).alias(p) for p in probs])
    return means.withColumn("config_name", F.lit(config_name))


def outcome_mix(report):
    """Transactions per workload and outcome, and their share of the workload in percent.

    Counts are summed first, so the window sees one row per outcome and workload.
    """
    counts = (
        report.withColumn("type", F.regexp_replace("type", "too-old", "other"))
        .groupBy(*_WORKLOAD, "type")
        .agg(F.sum("count").alias("count"))
    )
    of_workload = F.sum("count").over(Window.partitionBy(*_WORKLOAD))
    return counts.withColumn("pct", F.try_divide(F.col("count") * 100, of_workload))


def outcome_counts_wide(mix, types=OUTCOMES):
    """One count column per outcome and their sum; null where an outcome is missing."""
    wide = mix.groupBy(*_WORKLOAD).pivot("type", list(types)).agg(cell("count"))
    total = sum((F.col(t) for t in types[1:]), F.col(types[0]))
    return _by_workload(wide.withColumn("sum", total))


def outcome_pct_wide(mix, types=OUTCOMES, mh_values=None):
    """One percentage column per outcome.

    With ``mh_values`` there is one column per outcome and multi-home share (``write_50``), and
    the key is the contention ``hot`` = 1 / ``wl_hot``.
    """
    if mh_values is None:
        wide = mix.groupBy(*_WORKLOAD).pivot("type", list(types)).agg(cell("pct"))
        return _by_workload(wide)
    names = [f"{t}_{mh}" for t in types for mh in mh_values]
    wide = (
        mix.withColumn("_name", F.concat_ws("_", "type", "wl_mh"))
        .groupBy("wl_hot")
        .pivot("_name", names)
        .agg(cell("pct"))
    )
    return wide.select(F.try_divide(F.lit(1), "wl_hot").alias("hot"), *names).orderBy("hot")


def compare_systems(ours, other, configs, value="throughput", agg=None):
    """One column per configuration, next to the columns of the other system's report.

    Two rows of a configuration and workload raise, unless ``agg`` says what to make of them.
    """
    wide = ours.groupBy(*_WORKLOAD).pivot("config_name", list(configs)).agg(cell(value, agg))
    return _by_workload(wide.join(other, _WORKLOAD, "left"))


def relative_to(df, keys, base, values):
    """Columns divided by their value in the group's base row.

    ``base`` is the condition of that row; a group without one gives null. The result frame is
    stored, since it is read twice.
    """
    values = as_list(values)
    bases = {f"_base_{v}": F.max(F.when(base, F.col(v))) for v in values}
    related = with_facts(settle(df, "frame"), as_list(keys), bases)
    return related.withColumns(
        {v: F.try_divide(F.col(v), F.col(f"_base_{v}")) for v in values}
    ).drop(*bases)


def scale_by_max_wide(df, value, mh_values, agg=None):
    """Values divided by the largest of all, one column per multi-home share.

    The key is the contention ``hot`` = 1 / ``wl_hot``. Two rows of a workload raise, unless
    ``agg`` says what to make of their shares.
    """
    frame = settle(df.select("wl_mh", "wl_hot", value), "frame")
    scaled = with_facts(frame, [], {"_max": F.max(value)}).select(
        F.try_divide(F.lit(1), "wl_hot").alias("hot"),
        F.concat_ws("_", F.lit(value), "wl_mh").alias("_name"),
        F.try_divide(F.col(value), F.col("_max")).alias("_share"),
    )
    names = [f"{value}_{mh}" for mh in mh_values]
    return scaled.groupBy("hot").pivot("_name", names).agg(cell("_share", agg)).orderBy("hot")


def stack_systems(ours, other):
    """The rows of two results with different columns; ``wl_hot`` becomes 1 / ``wl_hot``."""
    both = ours.unionByName(other, allowMissingColumns=True)
    return both.withColumn("wl_hot", F.try_divide(F.lit(1), "wl_hot"))
