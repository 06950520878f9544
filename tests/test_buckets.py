"""Logs dealt by transaction: joins without an exchange, and when they are dealt anew."""

import os

import pytest
from pyspark.sql import functions as F

import runlens as rl
from runlens.operators import events as ev
from runlens.sources.buckets import bucketed
from tests.conftest import TXN_HEADER, write
from tests.test_plans import nodes

PAIRS = [("A", "B"), ("B", "C"), ("A", "C")]


def experiment(root, name, n):
    client = f"{root}/{name}/client/0"
    write(f"{client}/transactions.csv", TXN_HEADER, *[f"{i},0,0;1,0,0,0,1,5,9" for i in range(n)])
    lines = [f"{i},{e},{i * 1000 + t},{i % 3},0" for i in range(n) for e, t in (("A", 0), ("B", 50), ("C", 99))]
    write(f"{client}/txn_events.csv", "txn_id,event,time,machine,home", *lines)


@pytest.fixture
def place(tmp_path):
    for name in ("one", "two"):
        experiment(f"{tmp_path}/logs", name, 50)
    return f"{tmp_path}/logs", f"{tmp_path}/store"


def open_logs(spark, place, **options):
    return rl.RunLogs(spark, place[0], store=place[1], **options)


@pytest.fixture(autouse=True)
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def joins(logs):
    events, txns = logs.by_transaction("client_events", 4), logs.by_transaction("transactions", 4)
    return [
        ev.event_pairs(events, PAIRS, txns),
        ev.event_diff(events, txns, "A", "B", by_home=True),
        ev.hop_diff(events, txns, "A", "B", region=0),
    ]


def test_joins_by_transaction_move_nothing(spark, place):
    logs = open_logs(spark, place)
    found = joins(logs)
    for df in found:
        assert nodes(df, "Exchange") == 0 and nodes(df, "SortMergeJoin") == 1
    plain = [
        ev.event_pairs(logs.client_events, PAIRS, logs.transactions),
        ev.event_diff(logs.client_events, logs.transactions, "A", "B", by_home=True),
        ev.hop_diff(logs.client_events, logs.transactions, "A", "B", region=0),
    ]
    for a, b in zip(found, plain):
        assert nodes(b, "Exchange") > 0
        assert sorted(a.select(*b.columns).collect(), key=str) == sorted(b.collect(), key=str)
    assert found[0].count() == 300


def test_stored_layout_is_used_again_and_follows_the_logs(spark, place):
    root, store = place
    path = f"{store}/transactions_by_transaction"
    open_logs(spark, place).by_transaction("transactions", 4)
    files = {f for f in os.listdir(path) if f.endswith(".parquet")}
    assert len(files) == 4, "a bucket is one file"
    for name in [t.name for t in spark.catalog.listTables()]:
        spark.sql(f"drop table if exists `{name}`")  # as in a new session
    logs = open_logs(spark, place)
    assert nodes(joins(logs)[0], "Exchange") == 0
    assert {f for f in os.listdir(path) if f.endswith(".parquet")} == files
    experiment(root, "three", 7)
    assert open_logs(spark, place).by_transaction("transactions", 4).count() == 107
    assert open_logs(spark, place, refresh="never").by_transaction("transactions", 4).count() == 107
    assert open_logs(spark, place).by_transaction("transactions", 6).count() == 107
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 6


def test_needs_a_store(spark, place):
    with pytest.raises(ValueError, match="store"):
        rl.RunLogs(spark, place[0]).by_transaction("transactions")


def test_odd_columns_and_empty_tables(spark, tmp_path):
    rows = spark.range(20).select("id", F.array(F.lit("x")).alias("a b"), F.lit(1.5).alias("from"))
    for _ in range(2):
        found = bucketed(spark, f"{tmp_path}/t", lambda: rows, ["id"], 3)
        assert sorted(found.collect()) == sorted(rows.collect())
        spark.sql("show tables").collect()
    empty = bucketed(spark, f"{tmp_path}/e", lambda: rows.where("false"), ["id"], 3)
    assert empty.count() == 0 and empty.columns == rows.columns
