"""Run windows, throughput, latency and deadlocks on the small log tree."""

import pytest
from pyspark.sql import functions as F

import runlens as rl
from runlens.operators import throughput as thr
from runlens.operators.window import run_window
from runlens.plans import studies
from runlens.sources import logs

@pytest.fixture(scope="module")
def run(spark, tree):
    return rl.RunLogs(spark, tree)


def by_name(rows):
    return {r.prefix.split("/")[-1]: r for r in rows}


FIRST, OTHER = "alpha-sz3-asym_ratio60", "base-sz19"


def test_window_drops_warm_up(run):
    kept = run_window(run.transactions, start_s=10).collect()
    found = sorted((r.prefix.split("/")[-1], r.machine, r.txn_id) for r in kept)
    # Each machine sends at 1, 12 and 21 s; one of them sends at 1 s only and has no rows left.
    assert found == [(FIRST, m, t) for m in (0, 1) for t in (2, 3)] + [
        (OTHER, 0, 2),
        (OTHER, 0, 3),
    ]
    assert "first_at" not in kept[0].asDict() and "last_at" not in kept[0].asDict()


def test_window_upper_bound(run):
    ids = lambda **o: sorted({r.txn_id for r in run_window(run.transactions, **o).collect()})
    assert ids() == [1, 2, 3], "rows without a send time are dropped"
    assert ids(start_s=10, dur_s=5) == [2, 3], "nothing lies after the last send time"
    assert ids(start_s=10, dur_s=5, upper="from_start") == [2]
    assert ids(dur_s=11, upper="from_start") == [1, 2], "bounds are inclusive"
    with pytest.raises(ValueError):
        run_window(run.transactions, upper="middle")


def test_window_keeps_null_machines(spark):
    rows = spark.createDataFrame(
        [("a", None, 0.0), ("a", None, 20e9), ("a", 1, 5e9), ("a", 1, 15e9)],
        "prefix string, machine int, sent_at double",
    )
    kept = run_window(rows, start_s=10).collect()
    assert sorted((r.machine or 0, r.sent_at) for r in kept) == [(0, 20e9), (1, 15e9)]


def test_throughput(run):
    rates = by_name(thr.throughput(run.transactions, run.summary).collect())
    # Six rows with a send time of 60 committed; 3 rows over 20 s on each of two machines.
    sample = 6 / 60 * 100
    assert rates[FIRST].throughput == pytest.approx(2 * 3 * (100 / sample) / 20)
    sample = 4 / 60 * 100
    assert rates[OTHER].throughput == pytest.approx(3 * (100 / sample) / 20)
    per = thr.throughput(run.transactions, run.summary, per_machine=True).collect()
    alone = [r for r in per if r.prefix.endswith(OTHER) and r.machine == 1]
    assert alone[0].throughput is None, "one transaction gives no rate"


def test_throughput_in_window(run):
    rates = by_name(thr.throughput(run.transactions, run.summary, start_s=10).collect())
    assert rates[FIRST].throughput == pytest.approx(2 * 2 * (100 / 10) / 9)


def test_throughput_of_chosen_experiments(run):
    found = thr.throughput_by_experiment(
        run.transactions, run.summary, run.index, clients=3000
    ).collect()
    assert [r.config_name for r in found] == ["second.conf"]


def test_counters_and_sample(run):
    assert {r.committed for r in thr.committed(run.summary).collect()} == {60}
    found = by_name(thr.counter_throughput(run.summary).collect())
    assert found[FIRST].throughput == pytest.approx(2 * 30 / 20) and found[FIRST].scale == 3
    sample = by_name(thr.sample_rate(run.transactions, run.summary).collect())
    assert sample[FIRST].sample == pytest.approx(10)


def test_zero_elapsed_time(spark):
    rows = spark.createDataFrame([("a", 5, 0)], "prefix string, committed long, elapsed_time long")
    assert thr.counter_throughput(rows).first().throughput is None


def test_throughput_over_time(run):
    rows = thr.throughput_over_time(run.transactions, run.summary)
    found = [(r.time, r.throughput) for r in rows.collect() if r.prefix.endswith(FIRST)]
    assert found == [(1, pytest.approx(20)), (12, pytest.approx(20)), (21, pytest.approx(20))]


def test_event_throughput(run):
    rows = thr.event_throughput(run.server_events, sample=50)
    found = [(r.time, r.throughput) for r in rows.collect() if r.prefix.endswith(FIRST)]
    assert found == [(1, 8.0), (2, 4.0)]
    split = thr.event_throughput(run.server_events, per_machine=True, keys=())
    assert split.count() == 4 and {"partition", "region"} < set(split.columns)


def test_latency(run):
    rows = rl.latency(run.transactions, start_s=10)
    found = sorted((r.txn_id, r.latency) for r in rows.collect() if r.prefix.endswith(FIRST))
    assert found == [(2, 30.0), (2, 30.0), (3, 1.0), (3, 1.0)]
    assert rows.columns == ["prefix", "txn_id", "coordinator", "regions", "partitions", "latency"]


def test_latency_by_region(spark):
    rows = spark.createDataFrame(
        [("a", 1 << 16), ("b", 3 << 24), ("c", 11)], "prefix string, coordinator int"
    )
    index = spark.createDataFrame(
        [("a", "calvin.conf"), ("b", "janus.conf"), ("c", "other.conf")],
        "prefix string, config_name string",
    )
    found = rl.latency_by_region(rows, index).collect()
    assert {r.prefix: r.coordinator_region for r in found} == {"a": 1, "b": 3, "c": 2}
    plain = rl.latency_by_region(rows, rl.config_label(index)).collect()
    assert {r.prefix: r.coordinator_region for r in plain} == {"a": 1, "b": 3, "c": 2}
    only = rl.latency_by_region(rows, index, condition=F.col("prefix") == "b")
    assert [r.prefix for r in only.collect()] == ["b"]


def test_names_and_labels(spark):
    rows = spark.createDataFrame(
        [("x/jitter5-a", "one.conf.conf"), ("x/none", "two.conf")],
        "prefix string, config_name string",
    )
    tagged = rl.tag_from_name(rows, "jitter", r"jitter(\d+)").collect()
    assert [r.jitter for r in tagged] == [5, None]
    named = rl.config_label(rows, {"two.conf": "Second"}).collect()
    assert [r.config_name for r in named] == ["one", "Second"]
    assert rl.named(rows, "none").count() == 1


def test_other_region_and_class(spark):
    rows = spark.createDataFrame(
        [([0, 2, 3], [1], 0), ([1], [1, 2], 1), (None, None, 0)],
        "regions array<int>, partitions array<int>, coordinator_region int",
    )
    found = rl.other_region(rl.txn_class(rows)).collect()
    assert [r.other_region for r in found] == [2, None, None]
    assert [r.num_regions for r in found[:2]] == [3, 1]


def test_clock_deviation(run):
    found = rl.clock_deviation(run.txn_timestamps).collect()
    assert len(found) == 4 and {(r.n, r.mean_dev) for r in found} == {(1, 2.0)}
    found = rl.clock_deviation(run.txn_timestamps, "region").collect()
    assert {(r.region, r.n, r.mean_dev) for r in found} == {(0, 2, 2.0), (1, 2, 2.0)}


def test_deadlocks(run, spark, tree):
    totals = by_name(rl.deadlock_totals(run.deadlocks, run.index).collect())
    assert (totals[FIRST].deadlock_cnt, totals[FIRST].deadlock_sz) == (2, 10)
    none = by_name(rl.deadlock_totals(run.deadlocks.where("time > 500"), run.index).collect())
    assert (none[FIRST].deadlock_cnt, none[FIRST].deadlock_sz) == (0, None)
    row = studies.deadlock_study(run, config_name="first.conf").first()
    assert (row.config_name, row.wl_mh, row.committed, row.deadlocks) == ("first.conf", 50, 60, 2)
    assert (row.q1, row.median, row.q3, row.low, row.high) == (4.5, 5.0, 5.5, 4, 6)


def test_graph_sizes(run):
    rows = studies.graph_study(run, FIRST, 10, 20).collect()
    assert [(r.time, r.stable_graph_sz, r.unstable_graph_sz) for r in rows] == [(10, 2.0, 3.0)]


def test_studies(run, spark, tree):
    rates = studies.throughput_study(run, order="clients").collect()
    assert [r.config_name for r in rates] == ["first.conf", "second.conf"]
    one = studies.throughput_study(run, clients=200).collect()
    assert len(one) == 1 and one[0].throughput == rates[0].throughput
    lat = studies.latency_study(run, contains="base").collect()
    assert [(r.config_name, r.p50, r.p99) for r in lat] == [("second.conf", 5.0, 30.0)]
    single = studies.latency_study(run, homes="single", clients=200).first()
    assert (single.p50, single.p99) == (30.0, 30.0)
    multi = studies.latency_study(run, homes="multi", clients=200).first()
    assert (multi.p50, multi.p99) == (1.0, 5.0)
    curve = studies.throughput_latency_study(run).collect()
    assert {(r.config_name, r.clients) for r in curve} == {("first.conf", 200), ("second.conf", 3000)}
    scale = studies.scalability_study(run).collect()
    assert [r.scale for r in scale] == [3, 19]
    cdfs = studies.latency_cdfs(
        studies.regional_latency(run), {"first.conf": 200}, split=["first.conf"]
    )
    assert {r.homes for r in cdfs.collect()} == {"single", "multi"}
    tagged = rl.RunLogs(spark, tree, tags={"asym_ratio": r"asym_ratio(\d+)"})
    totals = studies.deadlock_totals_study(tagged, "asym_ratio").collect()
    assert [r.asym_ratio for r in totals] == [None, 60]
