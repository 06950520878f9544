"""Stores that follow their logs: what is rebuilt, and that nothing else is touched."""

import os
import shutil
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

import runlens as rl
from runlens.functions.paths import experiment_name
from runlens.sources import incremental
from tests.conftest import TXN_HEADER, write

ROW = "{},0,0;1,0,0,0,1,{},{}"


def log(root, name, n, machine=0, start=0):
    rows = [ROW.format(start + i, 10**9, 2 * 10**9 + i) for i in range(n)]
    write(f"{root}/{name}/client/{machine}/transactions.csv", TXN_HEADER, *rows)
    write(f"{root}/{name}/client/{machine}/metadata.csv", "duration,txns,clients,rate", f"60,0,{n},0")
    write(f"{root}/{name}/server/0-0/metadata.csv", "config_name", "a.conf")


def counts(df):
    found = df.groupBy(experiment_name().alias("name")).count().collect()
    return {unquote(r["name"]): r["count"] for r in found}


def stored_files(store, table="transactions"):
    out = {}
    for folder in os.listdir(f"{store}/{table}"):
        if folder.startswith("prefix="):
            files = os.listdir(f"{store}/{table}/{folder}")
            name = unquote(unquote(folder).rsplit("/", 1)[-1])  # a URI, escaped as a folder
            out[name] = {f for f in files if f.endswith(".parquet")}
    return out


@pytest.fixture
def place(tmp_path):
    root, store = f"{tmp_path}/logs", f"{tmp_path}/store"
    for name, n in (("a-sz1", 3), ("b [x]{y}*", 5), ("c=1%2", 7)):
        log(root, name, n)
    return root, store


def open_logs(spark, place, **options):
    return rl.RunLogs(spark, place[0], store=place[1], **options)


def test_added_changed_and_removed_experiments(spark, place):
    root, store = place
    want = {"a-sz1": 3, "b [x]{y}*": 5, "c=1%2": 7}
    assert counts(open_logs(spark, place).transactions) == want
    before = stored_files(store)
    assert counts(open_logs(spark, place).transactions) == want
    assert stored_files(store) == before, "nothing changed, nothing is written"

    log(root, "d", 11)
    want["d"] = 11
    assert counts(open_logs(spark, place, refresh="never").transactions) != want
    assert counts(open_logs(spark, place).transactions) == want
    after = stored_files(store)
    assert {k: v for k, v in after.items() if k != "d"} == before, "the others are as they were"

    log(root, "b [x]{y}*", 6, start=100)
    log(root, "c=1%2", 2, machine=1)
    want |= {"b [x]{y}*": 6, "c=1%2": 9}
    assert counts(open_logs(spark, place).transactions) == want
    last = stored_files(store)
    assert {k for k in last if last[k] != after[k]} == {"b [x]{y}*", "c=1%2"}

    shutil.rmtree(f"{root}/a-sz1")
    del want["a-sz1"]
    assert counts(open_logs(spark, place).transactions) == want
    assert stored_files(store) == {k: v for k, v in last.items() if k != "a-sz1"}
    assert counts(open_logs(spark, place, refresh="never").transactions) == want


def test_experiment_that_has_no_rows_any_more(spark, place):
    root, store = place
    open_logs(spark, place).transactions
    log(root, "a-sz1", 0)
    assert counts(open_logs(spark, place).transactions) == {"b [x]{y}*": 5, "c=1%2": 7}
    before = stored_files(store)
    assert counts(open_logs(spark, place).transactions) == {"b [x]{y}*": 5, "c=1%2": 7}
    assert stored_files(store) == before, "an empty log is known and not read again"


def test_index_follows_its_files(spark, place):
    root, store = place
    assert sorted(r.clients for r in open_logs(spark, place).index.collect()) == [3, 5, 7]
    before = stored_files(store, "index")
    files = set(os.listdir(f"{store}/index"))
    open_logs(spark, place).index.collect()
    assert set(os.listdir(f"{store}/index")) == files and stored_files(store, "index") == before
    log(root, "d", 11)
    assert sorted(r.clients for r in open_logs(spark, place).index.collect()) == [3, 5, 7, 11]


def test_broken_call_is_made_good(spark, place, monkeypatch):
    root, _ = place
    open_logs(spark, place).transactions
    log(root, "a-sz1", 4)
    log(root, "d", 1)
    with monkeypatch.context() as patched:

        def fail(*args):
            raise RuntimeError("lost the driver")

        patched.setattr(incremental, "_write_manifest", fail)
        with pytest.raises(RuntimeError):
            open_logs(spark, place).transactions
    assert counts(open_logs(spark, place).transactions)["a-sz1"] == 4
    assert counts(open_logs(spark, place).transactions)["d"] == 1


def test_refresh_all(spark, place):
    _, store = place
    open_logs(spark, place).transactions
    before = stored_files(store)
    assert sum(counts(open_logs(spark, place, refresh="all").transactions).values()) == 15
    assert all(before[k].isdisjoint(v) for k, v in stored_files(store).items())
    with pytest.raises(ValueError, match="refresh"):
        open_logs(spark, place, refresh="sometimes")


def test_a_missing_root_keeps_the_store(spark, place):
    root, store = place
    open_logs(spark, place).transactions
    os.rename(root, f"{root}-away")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        open_logs(spark, place).transactions
    assert counts(open_logs(spark, place, refresh="never").transactions)["a-sz1"] == 3


def test_nested_experiments(spark, tmp_path):
    root = f"{tmp_path}/logs"
    log(root, "one/x", 2)
    log(root, "two/x", 3)
    kinds = {"store": f"{tmp_path}/store", "experiment": "*/*"}
    assert rl.RunLogs(spark, root, **kinds).transactions.count() == 5
    log(root, "two/y", 4)
    rows = rl.RunLogs(spark, root, **kinds)
    named = rows.with_experiment(rows.transactions).groupBy("experiment").count().collect()
    assert dict(map(tuple, named)) == {"one/x": 2, "two/x": 3, "two/y": 4}


def test_files_are_listed_not_read(spark, place):
    files = incremental.source_files(spark, f"{place[0]}/*/client/*/transactions.csv")
    text = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<modificationTime:timestamp,length:bigint>" in text
    assert files.count() == 3
    assert files.where(F.col("prefix").isNull()).count() == 0


def scanned_rows(df):
    """The rows that the scans of a collected query gave, after row groups were passed over."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_range_of_time_reads_little(spark, tmp_path):
    """Logs come in no order; a second of a stored log reads a small part of its rows."""
    root, n = f"{tmp_path}/logs", 8000
    for name, machines in (("heavy", 4), ("light", 1)):
        for machine in range(machines):
            rows = [f"{i},A,{(i * 7919 % n) * 10**7},{machine},0" for i in range(n)]
            write(f"{root}/{name}/client/{machine}/txn_events.csv", "txn_id,event,time,machine,home", *rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        logs = rl.RunLogs(spark, root, store=f"{tmp_path}/store")
        events = logs.client_events
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    second = events.where("time >= 20e9 and time < 21e9")
    assert second.count() == 5 * 100
    assert scanned_rows(second) < 5 * n / 4 and scanned_rows(events) == 5 * n
    heavy = second.where(F.col("prefix").endswith("/heavy"))
    assert heavy.count() == 400 and scanned_rows(heavy) < 4 * n / 3
    # The files of an experiment are disjoint ranges.
    parts = events.groupBy(F.col("_metadata.file_path").alias("f"), "prefix").agg(
        F.min("time").alias("low"), F.max("time").alias("high")
    )
    ranges = sorted((r.prefix, r.low, r.high) for r in parts.collect())
    assert len(ranges) >= 6
    assert all(a[2] <= b[1] for a, b in zip(ranges, ranges[1:]) if a[0] == b[0])


def test_rebuilt_experiments_are_in_order_too(spark, place):
    root, store = place
    open_logs(spark, place).transactions
    log(root, "late", 50)
    rows = open_logs(spark, place).transactions.where(F.col("prefix").endswith("/late"))
    times = [r.sent_at for r in rows.select("sent_at").collect()]
    assert times == sorted(times) and len(times) == 50
