"""Deadlocks and dependency graphs."""

from pyspark.sql import functions as F

from runlens.operators.facts import as_list, with_metadata
from runlens.operators.stats import box_stats
from runlens.operators.throughput import committed
from runlens.sources.store import settle


def _in_region(deadlocks, region, region_col):
    return deadlocks.where(F.col(region_col) == region)


def deadlock_profile(
    deadlocks, index, summary, condition=None, region=0, region_col="region", stored=False
):
    """Deadlocks per configuration and share of multi-home transactions.

    Gives their number, the distribution of their sizes (box statistics) and the committed
    transactions of the same experiments. ``condition`` picks the experiments. Every server logs
    the deadlocks it sees, so one region's log is read. Experiments without a deadlock keep a row.
    ``stored`` says that the index is a stored table already.
    """
    by = ["config_name", "wl_mh"]
    index = index if stored else settle(index, "index")
    chosen = (index if condition is None else index.where(condition)).select("prefix", *by)
    seen = _in_region(deadlocks, region, region_col).select("prefix", "vertices")
    rows = with_metadata(seen, chosen, stored=True)
    totals = (
        chosen.join(committed(summary), "prefix", "left")
        .groupBy(*by)
        .agg(F.sum("committed").alias("committed"))
    )
    boxes = box_stats(rows, by, "vertices").withColumnRenamed("n", "deadlocks")
    return totals.join(boxes, by, "left").fillna(0, ["deadlocks", "outliers"])


def deadlock_totals(deadlocks, experiments=None, keys="prefix", region=0, region_col="region"):
    """Number and total size of the deadlocks per experiment.

    With ``experiments`` every one of them has a row: without deadlocks the number is 0 and the
    size null.
    """
    keys = as_list(keys)
    totals = (
        _in_region(deadlocks, region, region_col)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("deadlock_cnt"),
            F.sum("vertices").alias("deadlock_sz"),
        )
    )
    if experiments is None:
        return totals
    wanted = experiments.select(*keys).distinct()
    return wanted.join(totals, keys, "left").fillna(0, ["deadlock_cnt"])


def graph_size_series(resolver, t0=None, t1=None):
    """Graph sizes in thousand vertices over ``t0 <= time < t1``.

    The log counts the stable part within the unstable one; here the unstable part is the rest.
    """
    rows = resolver
    if t0 is not None:
        rows = rows.where(F.col("time") >= t0)
    if t1 is not None:
        rows = rows.where(F.col("time") < t1)
    stable = F.col("stable_graph_sz") / 1000
    return rows.withColumns(
        {
            "unstable_graph_sz": F.col("unstable_graph_sz") / 1000 - stable,
            "stable_graph_sz": stable,
        }
    )
