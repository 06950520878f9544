"""Report operators against known numbers of a measured system."""

import pytest
from pyspark.sql import functions as F

import runlens as rl
from runlens.plans import studies

# share of multi-home transactions, 1 / contention, total throughput, outcomes, their percentages,
# mean latencies, throughput relative to the lowest contention
GOLDEN = [
    (0, 1000000, 14550.2, (1308567, 1032, 2), (99.9210, 0.0788, 0.0002), (20.1, 26.9333, 29.9), 1.0),
    (0, 1000, 1956.3, (157294, 16423, 2353), (89.3361, 9.3275, 1.3364), (20.4333, 27.2833, 39.4667), 0.134452),
    (0, 10, 90.2, (146, 7912, 67), (1.7969, 97.3785, 0.8246), (788.55, 3735.7167, 5905.6), 0.006199),
    (50, 1000000, 11802.5, (1062189, 101, None), (99.9905, 0.0095, None), (86.8667, 1437.25, 1515.5333), 1.0),
    (50, 10, 39.9, (112, 3433, 45), (3.1198, 95.6267, 1.2535), (4982.85, 42054.9, 47602.55), 0.003381),
    (100, 1000000, 10078.0, (907004, 80, None), (99.9912, 0.0088, None), (810.9167, 1437.25, 1470.8), 1.0),
    (100, 10, 24.1, (186, 1975, 22), (8.5204, 90.4718, 1.0078), (5089.0833, 39012.6167, 46170.9), 0.002391),
]


@pytest.fixture(scope="module")
def report(spark):
    """The golden totals spread over regions; half of the other outcomes are called too-old."""
    rows = []
    for mh, hot, total, counts, _, latencies, _ in GOLDEN:
        for kind, n in zip(("write", "deadlock", "other"), counts):
            if n is None:
                continue
            share = total if kind == "write" else 0.0
            names = ("too-old", "other") if kind == "other" else (kind, kind)
            for i, name in enumerate(names):
                part = n // 2 if i == 0 else n - n // 2
                around = [p + (1 if i else -1) for p in latencies]
                rows.append((mh, hot, f"r{i}", name, part, share / 2, *around))
    return spark.createDataFrame(
        rows,
        "wl_mh int, wl_hot int, region string, type string, count int, throughput double, "
        "p50 double, p95 double, p99 double",
    )


def keyed(df):
    return {(r.wl_mh, r.wl_hot): r for r in df.collect()}


def test_throughput(report):
    rows = rl.report_throughput(report, "other_system")
    found = keyed(rows)
    for mh, hot, total, *_ in GOLDEN:
        assert found[mh, hot].other_system == pytest.approx(total)
    order = [(r.wl_mh, r.wl_hot) for r in rows.collect()]
    assert order == sorted(order, key=lambda k: (k[0], -k[1]))
    relative = keyed(rl.relative_to(rows, "wl_mh", F.col("wl_hot") == 1000000, "other_system"))
    for mh, hot, *_, share in GOLDEN:
        assert relative[mh, hot].other_system == pytest.approx(share, abs=1e-6)
    none = rl.relative_to(rows, "wl_mh", F.col("wl_hot") == 7, "other_system").collect()
    assert {r.other_system for r in none} == {None}


def test_outcomes(report):
    mix = rl.outcome_mix(report)
    counts, shares = keyed(rl.outcome_counts_wide(mix)), keyed(rl.outcome_pct_wide(mix))
    both = {round(1 / r.hot): r for r in rl.outcome_pct_wide(mix, mh_values=[0, 50, 100]).collect()}
    for mh, hot, _, golden, pcts, _, _ in GOLDEN:
        row = counts[mh, hot]
        assert (row.write, row.deadlock, row.other) == golden
        assert row["sum"] == (None if golden[2] is None else sum(golden))
        for kind, pct in zip(("write", "deadlock", "other"), pcts):
            wanted = None if pct is None else pytest.approx(pct, abs=5e-5)
            assert shares[mh, hot][kind] == wanted
            assert both[hot][f"{kind}_{mh}"] == wanted


def test_latency(report):
    found = keyed(rl.report_latency(report.where("type = 'write'"), "other"))
    for mh, hot, _, _, _, latencies, _ in GOLDEN:
        row = found[mh, hot]
        assert [row.p50, row.p95, row.p99] == pytest.approx(latencies)
        assert row.config_name == "other"


def test_compare(spark, report):
    ours = spark.createDataFrame(
        [(0, 1000000, "a", 20.0), (0, 10, "a", 5.0), (0, 10, "b", 1.0), (25, 10, "a", 2.0)],
        "wl_mh int, wl_hot int, config_name string, throughput double",
    )
    wide = rl.compare_systems(ours, rl.report_throughput(report, "other"), ["a", "b"])
    assert wide.columns == ["wl_mh", "wl_hot", "a", "b", "other"]
    found = keyed(wide)
    assert tuple(found[0, 10])[2:4] == (5.0, 1.0) and found[0, 10].other == pytest.approx(90.2)
    assert found[25, 10].other is None, "a left join"
    scaled = rl.scale_by_max_wide(ours.where("config_name = 'a'").withColumnRenamed("throughput", "a"), "a", [0, 25])
    rows = {round(1 / r.hot): (r.a_0, r.a_25) for r in scaled.collect()}
    assert rows == {1000000: (1.0, None), 10: (0.25, 0.1)}
    stacked = rl.stack_systems(ours, rl.report_latency(report, "other"))
    assert stacked.count() == 4 + len(GOLDEN)
    assert {r.wl_hot for r in stacked.collect()} == {1e-6, 1e-3, 0.1}


def test_comparison_study(spark, tree, report):
    run = rl.RunLogs(spark, tree, plain_names=True)
    rows = report.withColumn("wl_mh", F.lit(50)).withColumn("wl_hot", F.lit(1000))
    both, relative = studies.comparison_study(run, rows, ["first", "second"], "other", 1000)
    row = both.first()
    assert (row.wl_mh, row.wl_hot) == (50, 1000) and None not in (row.first, row.second, row.other)
    assert tuple(relative.first())[2:] == (1.0, 1.0, 1.0)
    scaled = studies.scaled_comparison(run, rows, "first", "other", [50]).first()
    assert (scaled.hot, scaled.first_50, scaled.other_50) == (0.001, 1.0, 1.0)
    stacked = studies.latency_comparison(run, rows, "other", clients=200)
    assert {r.config_name for r in stacked.collect()} == {"first", "other"}
    assert set(stacked.columns) > {"p50", "p95", "p99", "clients", "wl_mh"}
