"""Steps that read or compute their input more often than needed, or at a cost beyond its size."""

import os
import time

import pytest
from pyspark.sql import functions as F

import runlens as rl
from checks import queries
from checks.log_tree import write_tree
from runlens.functions.paths import experiment_name
from runlens.operators import events as ev
from runlens.sources import logs
from tests.test_buckets import PAIRS, experiment


def counted(spark, df):
    """``df`` and an accumulator of how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def see(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(see, df.schema), seen


def test_names_of_experiments_do_not_cost_the_square_of_the_root(spark):
    root = "file:/" + "r" * 30_000
    rows = spark.range(0, 200, 1, 8).select(F.concat(F.lit(root + "/run-"), "id").alias("prefix"))
    start = time.time()
    found = rows.select(experiment_name().alias("e")).distinct().count()
    assert found == 200 and time.time() - start < 20


@pytest.mark.parametrize(
    "path, names",
    [
        ("file:/a/b/c", ["c", "b/c", "a/b/c"]),
        ("file:/a/b/c//", ["c", "b/c", "a/b/c"]),
        ("a//b", ["b", "b", "b"]),
        ("x/a//b/", ["b", "b", "b"]),
        ("c", ["c", "c", "c"]),
        ("", ["", "", ""]),
        ("//", ["", "", ""]),
        (None, [None, None, None]),
    ],
)
def test_names_of_odd_paths(spark, path, names):
    row = spark.createDataFrame([(path,)], "prefix string")
    assert list(row.select(*[experiment_name(depth=d) for d in (1, 2, 3)]).first()) == names


def test_a_tree_computes_its_rows_once(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 4).select(
        F.concat(F.lit("e"), F.col("id") % 3).alias("_experiment"),
        (F.col("id") % 5).cast("int").alias("_directory"),
        F.col("id").alias("time"),
        F.when(F.col("id") % 2 == 0, "a, b;c").when(F.col("id") % 3 == 0, "").alias("text"),
        F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("number"),
    )
    df, seen = counted(spark, rows)
    root = write_tree(df, "server", "x.csv", ["time", "text", "number"], root=f"file://{tmp_path}/t")
    assert seen.value == 5000
    found = logs.scan(spark, logs.server_path(root, "*", "x.csv"), "time long, text string, number double")
    found = found.withColumn("_path", F.col("_metadata.file_path"))
    found = found.select(
        F.regexp_extract("_path", "/(e[0-9])/server/", 1).alias("_experiment"),
        F.regexp_extract("_path", "/server/([0-9])/", 1).cast("int").alias("_directory"),
        "time", "text", "number",
    )
    want = rows.withColumn("text", F.nullif("text", F.lit("")))
    assert found.count() == 5000 and found.exceptAll(want).isEmpty()


def test_by_transaction_needs_no_other_copy(spark, tmp_path):
    experiment(f"{tmp_path}/logs", "one", 50)
    run = rl.RunLogs(spark, f"{tmp_path}/logs", store=f"{tmp_path}/store")
    found = run.by_transaction("transactions", 4)
    assert os.listdir(f"{tmp_path}/store") == ["transactions_by_transaction"]
    plain = run.transactions
    assert found.columns == plain.columns and sorted(found.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("how", ["first", "last"])
def test_event_pairs_make_no_maps(spark, how):
    rows = [(i, i % 2, e, i * 10.0 + t) for i in range(30) for t, e in enumerate("ABCAB"[: i % 6])]
    events = spark.createDataFrame(rows, "txn_id long, machine int, event string, time double")
    found = ev.event_pairs(events, PAIRS, time=how)
    assert "map_from_entries" not in found._jdf.queryExecution().toString()
    states = ev.event_states(events, ["A", "B", "C"])
    assert sorted(found.collect()) == sorted(ev.pairs_of(states, PAIRS, how).collect())
    with pytest.raises(ValueError, match="time"):
        ev.event_pairs(events, PAIRS, time="middle")


def test_both_sides_of_the_metadata_of_a_study_read_stored_runs(spark, monkeypatch):
    plans = []

    def record(df, *args, **options):
        plans.append(df._jdf.queryExecution().toString())

    monkeypatch.setattr(queries, "write_tree", record)
    queries._study_logs(queries.Views(spark, "/root/testdata/sf0.001"))
    assert len(plans) == 2 and not any("o_orderstatus" in plan for plan in plans)
