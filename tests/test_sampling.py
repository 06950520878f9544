"""Draws: sizes, plans, and that they do not depend on where the logs lie."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import runlens as rl
from checks.compare import compare, connect
from runlens.functions.paths import experiment_name, tag_from_name
from runlens.operators import latency as lat
from runlens.operators.sampling import fixed_sample
from runlens.plans import studies
from tests.conftest import TXN_HEADER, write
from tests.test_plans import nodes, plan

LARGER = "/root/testdata/sf0.01"  # here strata have more rows than are drawn
DRAWN = [
    "latency_percentiles_stratified",
    "study_latency_multi_home",
    "study_latency_multi_home_fixed",
    "stratified_sample",
    "stratified_sample_fixed",
    "sample_rows",
]


@pytest.fixture(scope="module")
def con():
    return connect(LARGER)


@pytest.mark.parametrize("name", DRAWN)
def test_drawing_queries_where_rows_are_drawn(spark, con, name):
    assert compare(driver.queries()[name](spark, LARGER), con, name) is None


@pytest.fixture(scope="module")
def two_roots(tmp_path_factory):
    """The same tree under two roots whose own names look like experiments."""
    base = tmp_path_factory.mktemp("roots")
    first, second = f"{base}/janus-sz5/a", f"{base}/other-sz99/deep/b"
    rng = random.Random(0)
    for name, config in (("one-sz3", "x.conf"), ("two-sz7", "y.conf")):
        for machine in (0, 1):
            rows = []
            for i in range(1500):
                sent = 10**9 + i * 10**6
                took = rng.randrange(10**6, 10**9)
                txn, region = 2 * i + machine, rng.randrange(3)
                rows.append(f"{txn},{(region << 24) + i % 4},0;1,0,0,0,1,{sent},{sent + took}")
            client = f"{first}/{name}/client/{machine}"
            write(f"{client}/transactions.csv", TXN_HEADER, *rows)
            write(f"{client}/metadata.csv", "duration,txns,clients,rate", "60,0,100,0")
            write(
                f"{client}/txn_events.csv",
                "txn_id,event,time,machine,home",
                *[f"{2 * i + machine},{e},{t + i},{machine},0" for i in range(300) for e, t in (("A", 0), ("B", 5000))],
            )
        write(f"{first}/{name}/server/0-0/metadata.csv", "config_name", config)
    shutil.copytree(first, second)
    return first, second


def by_name(df, *cols):
    return sorted(df.withColumn("name", experiment_name()).select("name", *cols).collect())


@pytest.mark.parametrize("fixed", [False, True])
def test_copies_of_a_tree_give_the_same_percentiles(spark, two_roots, fixed):
    a, b = [
        by_name(
            studies.latency_study(rl.RunLogs(spark, root), homes="multi", method="exact", fixed=fixed),
            "p50", "p90", "p95", "p99",
        )
        for root in two_roots
    ]
    assert a == b and len(a) == 2


def test_breakdown_draws_by_experiment_and_transaction(spark, two_roots):
    drawn = []
    for root in two_roots:
        rows = studies.breakdown_study(rl.RunLogs(spark, root), "A", "B", fraction=0.3)
        assert "experiment" not in rows.columns
        drawn.append(by_name(rows, "txn_id"))
    assert drawn[0] == drawn[1]
    ids = {name: {t for n, t in drawn[0] if n == name} for name in ("one-sz3", "two-sz7")}
    assert all(100 < len(x) < 260 for x in ids.values())
    assert ids["one-sz3"] != ids["two-sz7"], "each experiment draws its own transactions"


def test_names_do_not_hold_the_root(spark, two_roots):
    for root in two_roots:
        logs = rl.RunLogs(spark, root, tags={"size": r"sz(\d+)"})
        assert sorted(r["size"] for r in logs.index.collect()) == [3, 7]
        assert lat.named(logs.index, "janus").count() == 0
        assert lat.named(logs.index, "sz3").count() == 1
        assert studies.latency_study(logs, contains="other").count() == 0


def test_nested_experiments(spark):
    rows = spark.createDataFrame([("file:/r-sz1/batch2/exp-sz3",), ("exp-sz4",), ("a//",)], "prefix string")
    assert [r[0] for r in rows.select(experiment_name()).collect()] == ["exp-sz3", "exp-sz4", "a"]
    assert rows.select(experiment_name(depth=2)).first()[0] == "batch2/exp-sz3"
    assert tag_from_name(rows, "b", r"batch(\d+)", depth=2).first()["b"] == 2
    assert rl.RunLogs(spark, "/x", experiment="batch*/*").depth == 2


def test_fixed_sizes(spark):
    rows = spark.range(0, 30000, 1, 7).select(
        "id",
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise("s").alias("stratum"),
        F.lit(1).alias("_draw2"),
    )
    rows = rows.unionByName(rows.where("id < 10").withColumn("stratum", F.lit("few")))
    found = fixed_sample(rows, "stratum", 100, "id")
    sizes = {r["stratum"]: r["count"] for r in found.groupBy("stratum").count().collect()}
    assert sizes == {"hot": 100, "s": 100, None: 100, "few": 10}
    again = fixed_sample(rows.repartition(3, "stratum"), "stratum", 100, "id")
    assert sorted(found.collect(), key=str) == sorted(again.collect(), key=str)
    more = fixed_sample(rows, "stratum", 150, "id")
    assert set(found.collect()) <= set(more.collect())


def test_fixed_sample_of_equal_rows(spark):
    rows = spark.range(0, 5000, 1, 4).select(F.lit(1).alias("key"), (F.col("id") % 5).alias("x"))
    assert fixed_sample(rows, [], 7, "key").count() == 7
    assert fixed_sample(rows.where("x > 9"), "x", 7, "key").count() == 0


def test_fixed_sample_limits_before_it_moves_rows(spark):
    rows = spark.range(0, 10**6, 1, 8).select((F.col("id") % 2).alias("stratum"), "id")
    found = fixed_sample(rows, "stratum", 10, "id")
    assert nodes(found, "Exchange") == 2 and nodes(found, "Join") == 0
    assert nodes(found, "Range") == 1, "one scan"
    tree = plan(found).split("\n\n\n")[0].splitlines()
    deep = [line for line in tree if "Exchange" in line or "WindowGroupLimit" in line]
    # From the scan up: limited, moved by (stratum, salt), limited, moved by stratum, limited.
    kinds = ["move" if "Exchange" in line else "limit" for line in deep]
    assert kinds[-2:] == ["move", "limit"] and kinds.count("move") == 2 and kinds[0] == "limit"
