import os

import pytest
from pyspark.sql import functions as F

import runlens as rl
from runlens.operators import events as ev
from runlens.plans import studies
from tests.test_plans import nodes, plan

MS = 1000000


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        # txn, event, time, machine, home: two starts and two ends, on two machines
        (1, "A", 10 * MS, 5, 0),
        (1, "A", 30 * MS, 4, 0),
        (1, "B", 50 * MS, 6, 0),
        (1, "B", 90 * MS, 4, 0),
        (1, "C", 99 * MS, 4, 0),
        (2, "A", 10 * MS, 4, 1),
        (3, "B", 10 * MS, 4, 1),
        # no home: dropped where the home is a key
        (2, "A", 20 * MS, 9, None),
        (2, "B", 30 * MS, 9, None),
    ]
    return spark.createDataFrame(
        [(t, e, float(w), m, h) for t, e, w, m, h in rows],
        "txn_id long, event string, time double, machine int, home int",
    )


@pytest.fixture(scope="module")
def txns(spark):
    return spark.createDataFrame(
        [(1, [0, 1], [2], 1.0, 2.0, 7), (2, [0], [1], 1.0, 2.0, 7)],
        "txn_id long, regions array<int>, partitions array<int>, sent_at double, "
        "received_at double, machine int",
    )


def test_events_latency(events):
    rows = rl.events_latency(events, "A", "B").collect()
    assert sorted((r.txn_id, r.machine, r.A_to_B) for r in rows) == [(1, 4, 60.0), (2, 9, 10.0)]
    assert rl.events_latency(events, "A", "B", "gap").columns == ["txn_id", "machine", "gap"]
    assert rl.events_latency(events, "A", "MISSING").count() == 0


def test_event_diff(events, txns):
    row = rl.event_diff(events, txns, "A", "B", by_home=True, by_machine=False).collect()
    assert len(row) == 1, "pairs with one side missing are dropped"
    row = row[0]
    assert (row["from"], row.to, row["diff"]) == (30 * MS, 90 * MS, 60.0), "last times"
    assert (row.num_regions, row.num_partitions, row.coordinator_region) == (2, 1, 7)
    assert "sent_at" not in row.asDict() and "machine" not in row.asDict()
    assert rl.event_diff(events, txns, "A", "B").columns[:2] == ["txn_id", "machine"]


def test_event_diff_server(spark):
    rows = spark.createDataFrame(
        [(1, "A", 1.0 * MS, 0, 1), (1, "B", 4.0 * MS, 0, 2), (1, "B", 3.0 * MS, 0, 1)],
        "txn_id long, event string, time double, partition int, region int",
    )
    assert rl.event_diff_server(rows, "A", "B").first()["diff"] == 3.0
    by_region = rl.event_diff_server(rows, "A", "B", by_region=True).collect()
    assert [(r.region, r["diff"]) for r in by_region] == [(1, 2.0)]


def test_hop_diff_takes_first_times_and_smallest_machines(events, txns):
    row = rl.hop_diff(events, txns, "A", "B", 7).first()
    assert (row.from_time, row.to_time, row["diff"]) == (10 * MS, 50 * MS, 40.0)
    assert (row.from_machine, row.to_machine) == (4, 4), "not the machines of the first events"
    assert rl.hop_diff(events, txns, "A", "B", 0).count() == 0


def test_after_the_breakdown(spark):
    diffs = spark.createDataFrame(
        [(7, 0, 50.0, 60.0, 5.0), (7, 0, 20.0, 40.0, None), (7, 1, 10.0, 30.0, 9.0), (8, 0, 90.0, 95.0, 1.0)],
        "coordinator_region int, home int, `from` double, `to` double, diff double",
    )
    assert rl.slow_events(diffs, 4).count() == 2
    counts = {r.coordinator_region: (r.home, r["diff"]) for r in rl.region_counts(diffs).collect()}
    assert counts == {7: (3, 2), 8: (1, 1)}
    series = rl.diff_series(diffs, 7, 0).collect()
    assert [(r["from"], r["diff"]) for r in series] == [(10.0, None), (40.0, 5.0)]
    ends = rl.diff_series(diffs, 7, time="to").collect()
    assert [r.to for r in ends] == [0.0, 10.0, 30.0]


def test_breakdown_study(spark, tree):
    run = rl.RunLogs(spark, tree)
    diffs = studies.breakdown_study(run, "ENTER_WORKER", "EXIT_WORKER")
    rows = diffs.collect()
    # Both experiments log transaction 1 on both machines; facts come from the same experiment.
    assert len(rows) == 8 and {r["diff"] for r in rows} == {6.0}
    one = studies.breakdown_study(run, "ENTER_WORKER", "EXIT_WORKER", name="base-sz19")
    assert {r.prefix.split("/")[-1] for r in one.collect()} == {"base-sz19"}
    curve = studies.breakdown_cdfs(one, "coordinator_region").collect()
    assert sorted(r.y for r in curve if r.coordinator_region == 0) == [0.5, 1.0]


def many_pairs(spark):
    rows = [
        ("r", 1, 0, "A", 10), ("r", 1, 0, "A", 30), ("r", 1, 0, "B", 90), ("r", 1, 0, "C", 95),
        ("r", 1, 1, "A", 5), ("r", 2, 0, "B", 7), ("r", 2, 0, "C", None), ("r", 3, 0, None, 4),
        ("s", 1, 0, "A", 1), ("s", 1, 0, "B", 2), (None, 1, 0, "A", 1), (None, 1, 0, "B", 9),
    ]
    rows = [(p, t, m, e, None if x is None else x * 1e6) for p, t, m, e, x in rows]
    return spark.createDataFrame(rows, "prefix string, txn_id long, machine int, event string, time double")


PAIRS = {"ab": ("A", "B"), "bc": ("B", "C"), "ac": ("A", "C"), "none": ("A", "Z")}


def test_many_pairs_at_once(spark):
    events = many_pairs(spark)
    rows = ev.event_pairs(events, PAIRS).collect()
    found = sorted((r.prefix, r.txn_id, r.machine, r.pair, r["diff"]) for r in rows)
    assert found == [("r", 1, 0, "ab", 60), ("r", 1, 0, "ac", 65), ("r", 1, 0, "bc", 5), ("s", 1, 0, "ab", 1)]
    first = ev.event_pairs(events, PAIRS, time="first").where("pair = 'ab' and prefix = 'r'").first()
    assert first["diff"] == 80
    wide = {r.prefix: r for r in ev.event_pairs(events, PAIRS, wide=True).collect()}
    assert wide["r"].asDict() == {
        "prefix": "r", "txn_id": 1, "machine": 0, "ab": 60, "bc": 5, "ac": 65, "none": None
    }
    assert wide["s"].ac is None and len(wide) == 2


def test_pairs_agree_with_one_pair_at_a_time(spark):
    events = many_pairs(spark)
    for name, (start, end) in PAIRS.items():
        one = sorted(ev.events_latency(events, start, end, "diff").collect())
        many = ev.event_pairs(events, [(start, end), ("B", "A")]).where(F.col("pair") == f"{start}_to_{end}")
        assert sorted(many.select("prefix", "txn_id", "machine", "diff").collect()) == one, name


def test_states_of_parts_add_up(spark):
    events = many_pairs(spark)
    half = [ev.event_states(events.where(F.col("time") % 2e6 == k)) for k in (0.0, 1e6)]
    merged = ev.merged_states(half[0].unionByName(half[1]))
    whole = ev.event_states(events)
    named = ev.event_states(events, ["A", "B", "C", "B"])
    want = sorted(ev.pairs_of(whole, PAIRS).collect())
    assert sorted(ev.pairs_of(merged, PAIRS).collect()) == want
    assert sorted(ev.pairs_of(named, PAIRS).collect()) == want


def test_pairs_take_one_scan_and_one_shuffle(spark):
    stored = rl.settle(many_pairs(spark))
    pairs = [(a, b) for a in "ABCDEF" for b in "ABCDEF" if a != b]
    for wide in (False, True):
        found = ev.event_pairs(stored, pairs, wide=wide)
        assert nodes(found, "Exchange") == 1 and nodes(found, "Scan parquet") == 1
    assert "partial_max" in plan(found), "times are combined before they are moved"


def test_breakdowns_of_runs(spark, tree):
    logs = rl.RunLogs(spark, tree)
    pairs = [("ENTER_WORKER", "EXIT_WORKER"), ("EXIT_WORKER", "ENTER_WORKER")]
    rows = studies.breakdowns_study(logs, pairs).collect()
    one = studies.breakdown_study(logs, *pairs[0]).collect()
    assert sorted(r["diff"] for r in rows if r.pair == "ENTER_WORKER_to_EXIT_WORKER") == sorted(
        r["diff"] for r in one
    )
    assert len(rows) == 2 * len(one) and {r.experiment for r in rows} == set(os.listdir(tree))
    few = studies.breakdowns_study(logs, pairs, names=["base-sz19"]).collect()
    assert {r.experiment for r in few} == {"base-sz19"}
    by_index = studies.breakdowns_study(logs, pairs, clients=3000).collect()
    assert sorted(map(str, by_index)) == sorted(map(str, few))
    assert studies.breakdowns_study(logs, pairs, fraction=0.0).count() == 0
