"""What the plans must and must not hold."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import runlens as rl
from checks.views import view
from runlens.plans import studies

SMALL = "/root/testdata/sf0.001"


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def nodes(df, name):
    """Nodes of the plan, counted in the tree at its head."""
    tree = plan(df).split("\n\n\n")[0]
    return len(re.findall(rf"\b{name}\b", tree))


@pytest.fixture(scope="module")
def txns(spark):
    return rl.settle(view(spark, SMALL, "txns"))


@pytest.fixture(scope="module")
def summary(spark):
    return rl.settle(view(spark, SMALL, "summary"))


def test_window_moves_no_log_rows(txns):
    """The bounds are broadcast, so the log is neither shuffled nor sorted."""
    kept = rl.run_window(txns, start_s=10)
    assert nodes(kept, "Exchange") == 0 and nodes(kept, "Sort") == 0
    assert nodes(kept, "Window") == 0 and nodes(kept, "BroadcastHashJoin") == 1


def test_window_beyond_the_broadcast_size(spark, txns):
    """Bounds too large to broadcast are joined by a shuffle, with the same rows."""
    small = sorted(rl.run_window(txns, start_s=10).select("txn_id").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = rl.run_window(txns, start_s=10)
        assert nodes(large, "BroadcastHashJoin") == 0
        assert sorted(large.select("txn_id").collect()) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


def test_heavy_experiment_is_split(spark):
    """A choice of experiments too large to broadcast splits a heavy one, aggregate or not."""
    rows = spark.range(0, 400000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5((F.col("id") % 5003).cast("string"))).alias("prefix"),
        (F.col("id") % 7).cast("int").alias("machine"),
        F.md5(F.col("id").cast("string")).alias("pad"),
    )
    rows = rl.settle(rows)
    index = rl.settle(rows.select("prefix").distinct())
    for name, value in SPLIT.items():
        spark.conf.set(name, value)
    try:
        chosen = studies._of(rows, index, {"any": 1})
        found = chosen.groupBy("prefix", "machine").agg(F.count("pad").alias("n"))
        assert found.agg(F.sum("n")).first()[0] == 400000
        found.collect()
        assert "SortMergeJoin(skew=true)" in plan(found)
    finally:
        for name in SPLIT:
            spark.conf.unset(name)


def test_heavy_machine_is_split(spark):
    """Beyond the broadcast size the rows of a heavy machine are joined by several tasks."""
    rows = spark.range(0, 400000, 1, 8).select(
        F.lit("run").alias("prefix"),
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5003).alias("machine"),
        (F.col("id") * 100000.0).alias("sent_at"),
        F.md5(F.col("id").cast("string")).alias("pad"),
    )
    rows = rl.settle(rows)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        kept = rl.run_window(rows, start_s=10).agg(F.count("pad"))
        counted = kept.collect()[0][0]
        assert "SortMergeJoin(skew=true)" in plan(kept)
    finally:
        for name in settings:
            spark.conf.unset(name)
    first = rows.groupBy("machine").agg(F.min("sent_at").alias("low"))
    wanted = rows.join(first, "machine").where("sent_at >= low + 10000000000").count()
    assert counted == wanted


def test_plain_window_is_a_filter(txns):
    kept = rl.run_window(txns)
    assert nodes(kept, "Exchange") == 0 and nodes(kept, "BroadcastHashJoin") == 0


def test_throughput_reads_three_columns(txns, summary):
    text = plan(rl.throughput(txns, summary, start_s=10))
    log = [s for s in re.findall(r"ReadSchema: (\S+)", text) if "sent_at" in s]
    assert len(log) == 1, "the log is scanned once more after its spans"
    assert "regions" not in log[0] and "received_at" not in log[0]


def test_untrimmed_throughput_scans_only_spans(txns, summary):
    text = plan(rl.throughput(txns, summary))
    assert "sent_at" not in "".join(re.findall(r"ReadSchema: (\S+)", text))


def test_event_pair_is_one_scan_and_one_exchange(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select(
        F.col("user_id").alias("txn_id"),
        F.col("event_type").alias("event"),
        F.col("value").alias("time"),
        F.lit(0).alias("machine"),
    )
    diff = rl.events_latency(events, "click", "purchase")
    assert nodes(diff, "Scan") == 1 and nodes(diff, "Exchange") == 1 and nodes(diff, "Join") == 0
    text = plan(diff)
    assert re.search(r"PushedFilters: \[.*In\(event_type, \[click,purchase\]\)", text)
    assert "props" not in text


def test_name_filter_reaches_the_scan(txns):
    text = plan(rl.latency(rl.named(txns, "sz7")))
    assert re.search(r"PushedFilters: \[.*StringContains\(prefix,sz7\)", text)


def test_percentiles_combine_before_the_shuffle(txns):
    found = rl.latency_percentiles(rl.latency(txns))
    assert "partial_percentile_approx" in plan(found) and nodes(found, "Exchange") == 1


def test_cdf_does_not_gather_a_key(txns):
    """The result reads the stored order; windows see a piece of a key at a time."""
    curve = rl.cdf(rl.latency(txns), "prefix", "latency", "txn_id")
    assert nodes(curve, "Window") == 0 and nodes(curve, "Exchange") == 0
    curve = rl.cdf(rl.latency(txns), "prefix", "latency")
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan(curve))
    assert windows and all("_piece" in spec for spec in windows)


def test_machine_filter_reaches_the_csv_scan(spark, tree):
    rows = rl.read_transactions(spark, tree).where("machine = 1")
    assert nodes(rows, "Exchange") == 0
    assert re.search(r"DataFilters: .*_metadata|file_path", plan(rows))


def test_stored_logs_prune_experiments(spark, tree, tmp_path):
    run = rl.RunLogs(spark, tree, store=f"{tmp_path}/store")
    rows = run.transactions.where(F.col("prefix").endswith("base-sz19"))
    assert re.search(r"PartitionFilters: \[.*prefix", plan(rows))


def test_chosen_experiments_prune_the_stored_log(spark, tree, tmp_path):
    """The index picks the folders of the log that are read at all."""
    run = rl.RunLogs(spark, tree, store=f"{tmp_path}/store")
    rows = studies._of(run.transactions, run.experiments(clients=200), {"clients": 200})
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", plan(rows))
    assert rows.select("prefix").distinct().count() == 1
    found = rl.latency_by_region(
        rl.latency(run.transactions), run.index, condition=F.col("clients") == 200, stored=True
    )
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", plan(found))
