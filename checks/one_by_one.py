"""Throughput of all experiments: a job for each experiment in turn against one keyed job.

``python -m checks.one_by_one [sf_dir]`` writes the transaction and counter logs of 45 experiments
and prints the seconds of both ways, and whether they agree.
"""

import sys
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.compare import session
from checks.log_tree import write_tree
from checks.queries import _TXN_COLS, joined
from checks.views import view
from runlens.operators.throughput import throughput
from runlens.sources import logs


def write_logs(spark, sf_dir):
    name = F.replace("prefix", F.lit("/"), F.lit("-")).alias("_experiment")
    machine = F.col("machine").alias("_directory")
    txns, summary = view(spark, sf_dir, "txns"), view(spark, sf_dir, "summary")
    lists = {c: joined(c) for c in ("regions", "partitions")}
    rest = {c: F.lit(0) for c in _TXN_COLS if c not in txns.columns}
    rows = txns.select(name, machine, "*").withColumns({**lists, **rest})
    root = write_tree(rows, "client", "transactions.csv", _TXN_COLS)
    cols = logs.schemas.names(logs.schemas.SUMMARY)
    rows = summary.select(name, machine, "*")
    rows = rows.withColumns({c: F.lit(0) for c in cols if c not in summary.columns})
    write_tree(rows, "client", "summary.csv", cols, root=root)
    return root


def one(spark, root, name):
    """Three actions for one experiment, with the window bounds from window functions."""
    txns = logs.read_transactions(spark, root, name).where(F.col("sent_at").isNotNull())
    done = logs.read_summary(spark, root, name).agg(F.sum("committed")).first()[0]
    sample = txns.count() / done * 100
    first_at = F.min("sent_at").over(Window.partitionBy("machine"))
    rates = (
        txns.withColumn("first_at", first_at)
        .where(F.col("sent_at") >= F.col("first_at") + 10000000000)
        .groupBy("machine")
        .agg(
            F.try_divide(
                F.count("sent_at") * 1000000000 * (100 / sample), F.max("sent_at") - F.min("sent_at")
            ).alias("rate")
        )
    )
    return rates.agg(F.sum("rate")).first()[0]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = session()
    root = write_logs(spark, sf_dir)

    def together():
        found = throughput(
            logs.read_transactions(spark, root), logs.read_summary(spark, root), start_s=10
        )
        return {r.prefix.split("/")[-1]: r.throughput for r in found.collect()}

    names = list(together())
    start = time.perf_counter()
    keyed = together()
    middle = time.perf_counter()
    single = {name: one(spark, root, name) for name in names}
    end = time.perf_counter()
    agree = all(abs(keyed[n] - single[n]) < 1e-6 for n in names)
    print(f"{len(names)} experiments: one job {middle - start:.1f} s, in turn {end - middle:.1f} s")
    print(f"agree: {agree}")


if __name__ == "__main__":
    main()
