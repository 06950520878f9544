import os
import tarfile
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import runlens as rl
from runlens.sources import archives, index, logs, reports, store
from tests.conftest import TXN_HEADER, write


def named(df):
    return df.withColumn("exp", F.element_at(F.split("prefix", "/"), -1))


def test_transactions(spark, tree):
    rows = named(logs.read_transactions(spark, tree)).where("exp like 'alpha%' and machine = 0")
    rows = {r.txn_id: r for r in rows.collect()}
    assert rows[1].regions == [0, 1] and rows[1].partitions == [1, 2]
    assert rows[1].global_log_pos == [9, 4], "log positions keep their order"
    assert rows[2].global_log_pos is None, "an empty field is null"
    assert rows[3].regions == [1, None], "a malformed number is null and last"
    assert rows[3].partitions is None
    assert rows[4].sent_at is None
    assert rows[1].sent_at == 1e9 and rows[1].restarts == 0
    assert logs.read_transactions(spark, tree).count() == 13


def test_one_experiment(spark, tree):
    rows = logs.read_transactions(spark, tree, experiment="base-*")
    assert {r.prefix.split("/")[-1] for r in rows.select("prefix").collect()} == {"base-sz19"}


def test_log_in_parts(spark, tmp_path):
    for part in (0, 1):
        write(
            f"{tmp_path}/exp/client/7/transactions.csv/part-{part}.csv",
            TXN_HEADER,
            f"{part},0,0,0,0,0,0,1,2",
        )
    rows = logs.read_transactions(spark, str(tmp_path)).collect()
    assert sorted((r.txn_id, r.machine) for r in rows) == [(0, 7), (1, 7)]
    assert {r.prefix.split("/")[-1] for r in rows} == {"exp"}


def test_summary(spark, tree):
    rows = logs.read_summary(spark, tree)
    assert rows.count() == 4
    assert {r.machine for r in rows.collect()} == {0, 1}
    assert rows.first().elapsed_time == 20000000000


def test_deadlocks_binds_by_position(spark, tree):
    rows = logs.read_deadlocks(spark, tree)
    assert rows.columns == ["time", "partition", "region", "vertices", "prefix"]
    assert {r.region for r in rows.collect()} == {0, 1}
    old = logs.read_deadlocks(spark, tree, region_col="replica", check_header=True)
    assert old.where("replica = 1").count() == 4
    with pytest.raises(Exception, match="(?i)header"):
        logs.read_deadlocks(spark, tree, check_header=True).collect()


def test_txn_timestamps(spark, tree):
    rows = named(logs.read_txn_timestamps(spark, tree)).where("exp like 'alpha%'").collect()
    found = {(r.txn_id, r.region, r.partition): r.dev for r in rows}
    assert found == {(1, 0, 0): 2.0, (1, 1, 0): 2.0, (2, 0, 0): None, (2, 1, 0): None}


def test_measurements(spark, tree):
    rows = logs.read_measurements(spark, tree)
    assert rows.count() == 4 and dict(rows.dtypes)["type"] == "int"
    old = logs.read_measurements(spark, tree, legacy=True, kind=2)
    assert dict(old.dtypes)["type"] == "bigint" and "replica" in old.columns
    assert [r.data for r in old.collect()] == [7.0, 7.0], "server 0-0 only, in ms"
    assert logs.read_measurements(spark, tree, kind=1).count() == 0


def test_events_links_resolver(spark, tree):
    assert logs.read_client_events(spark, tree).count() == 16
    assert logs.read_server_events(spark, tree).count() == 12
    links = logs.read_link_latency(spark, tree)
    assert {r.src for r in links.collect()} == {"0-0", "1-0"}
    assert logs.read_resolver(spark, tree).count() == 4
    assert logs.read_resolver(spark, tree, server="*").count() == 8


def test_index(spark, tree):
    rows = {r.prefix.split("/")[-1]: r for r in index.experiment_index(spark, tree).collect()}
    assert len(rows) == 2
    row = rows["alpha-sz3-asym_ratio60"]
    assert (row.config_name, row.clients, row.wl_hot, row.wl_mh) == ("first.conf", 200, 1000, 50)
    assert (row.duration, row.sample) == (60, 10)


def test_index_conflicts(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/e/server/0-0/metadata.csv", "config_name,note", "a.conf,s")
    for machine, clients in ((0, 5), (1, 7)):
        write(
            f"{root}/e/client/{machine}/metadata.csv",
            "duration,txns,clients,rate,note",
            f"60,x,{clients},0,c",
        )
    kept = index.experiment_index(spark, root, conflicts="keep").collect()
    assert sorted(r.clients for r in kept) == [5, 7]
    assert kept[0].note == "s" and kept[0].client_note == "c" and kept[0].txns is None
    first = index.experiment_index(spark, root, conflicts="first").collect()
    assert [r.clients for r in first] == [5]
    with pytest.raises(Exception, match="disagree on client metadata"):
        index.experiment_index(spark, root).collect()


def test_index_checks_headers(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/e/server/0-0/metadata.csv", "config_name", "a.conf")
    write(f"{root}/e/client/0/metadata.csv", "duration,txns,clients,wl:hot", "60,5,1,")
    write(f"{root}/e/client/1/metadata.csv", "wl:hot,clients,duration,txns", ",1,60,5")
    row = index.experiment_index(spark, root).collect()
    assert [(r.duration, r.txns, r.clients, r.wl_hot) for r in row] == [(60, 5, 1, None)]
    with pytest.raises(Exception, match="different columns"):
        index.experiment_index(spark, root, check_header=True).collect()


def test_index_reads_quoted_values(spark, tmp_path):
    write(f"{tmp_path}/e/server/0-0/metadata.csv", "config_name,note", 'a.conf,"x, ""y"""')
    write(f"{tmp_path}/e/client/0/metadata.csv", "duration,clients", "60,1")
    assert index.experiment_index(spark, str(tmp_path)).first().note == 'x, "y"'


def test_reports(spark, tmp_path):
    write(
        f"{tmp_path}/r.csv",
        "wl:mh,wl:hot,region,type,count,throughput,avg,p50,p95,p99,pMax",
        "0,10,east,write,5,1.5,1,2,3,4,5",
    )
    row = reports.read_report(spark, f"{tmp_path}/r.csv").first()
    assert (row.wl_mh, row.wl_hot, row.type, row["count"], row.pMax) == (0, 10, "write", 5, 5.0)
    write(
        f"{tmp_path}/l.csv",
        "wl:mh,wl:hot,region,throughput,avg,p50,p95,p99,pMax",
        "50,10,east,1.5,1,2,3,4,5",
    )
    row = reports.read_latency_report(spark, f"{tmp_path}/l.csv").first()
    assert (row.wl_mh, row.region, row.p50) == (50, "east", 2.0)


def pack(path, members):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with tarfile.open(path, "w:gz") as tar:
        for name, source in members:
            tar.add(source, arcname=name)


@pytest.mark.parametrize("suffix", [".tar.gz", ".tgz"])
def test_archives(spark, tree, tmp_path, suffix):
    """Archived logs give the same rows as the tree, and members of other kinds are not read."""
    for name in os.listdir(tree):
        for machine in (0, 1):
            source = f"{tree}/{name}/client/{machine}"
            pack(
                f"{tmp_path}/{name}/client/{machine}{suffix}",
                [(f"./{f}", f"{source}/{f}") for f in os.listdir(source)],
            )
    glob = f"{tmp_path}/*/client/*{suffix}"
    lines = archives.read_archives(spark, glob, suffix)
    assert lines.columns == ["archive", "member", "line_no", "line"]
    found = named(archives.archived_table(lines, "transactions.csv", suffix)).drop("prefix")
    wanted = named(logs.read_transactions(spark, tree)).drop("prefix").select(*found.columns)
    assert sorted(found.collect(), key=str) == sorted(wanted.collect(), key=str)
    counters = archives.archived_table(lines, "summary.csv", suffix)
    assert counters.count() == 4 and counters.agg(F.sum("committed")).first()[0] == 120
    assert all(r.prefix.split("/")[-1] in os.listdir(tree) for r in counters.collect())
    direct = archives.read_archived(spark, glob, "summary.csv", suffix)
    assert sorted(direct.collect(), key=str) == sorted(counters.collect(), key=str)
    few = archives.read_archives(spark, glob, suffix, members=archives._member_pattern("summary.csv"))
    assert {r.member for r in few.collect()} == {"summary.csv"}


def test_archives_on_an_unknown_file_system():
    read = archives._line_reader(10, ".tar.gz", None)
    batch = pa.RecordBatch.from_pydict({"path": ["odd://store/a.tar.gz"]})
    with pytest.raises(ValueError, match="odd://store/a.tar.gz"):
        list(read([batch]))


def test_store_of_an_empty_table(spark, tree, tmp_path):
    path = str(tmp_path / "stored")
    for _ in range(2):
        rows = store.materialize(
            spark, path, lambda: logs.read_deadlocks(spark, tree).where("false"), partition_by="prefix"
        )
        assert rows.count() == 0
        assert set(rows.columns) == {"time", "partition", "region", "vertices", "prefix"}


def test_archive_in_archive(spark, tree, tmp_path):
    inner = f"{tmp_path}/inner"
    names = os.listdir(tree)
    for name in names:
        pack(f"{inner}/{name}/server/0-0.tar.gz", [("", f"{tree}/{name}/server/0-0")])
    pack(f"{tmp_path}/out/study.tar.gz", [(n, f"{inner}/{n}") for n in names])
    lines = archives.read_archives(spark, f"{tmp_path}/out/*.tar.gz", batch_rows=3)
    found = archives.archived_table(lines, "txn_timestamps.csv")
    rows = [r for r in found.collect() if r.txn_id == 1]
    named = sorted((r.prefix.split("/")[-1], r.txn_id, r.region, r.dev) for r in rows)
    assert named == [("alpha-sz3-asym_ratio60", 1, 0, 2.0), ("base-sz19", 1, 0, 2.0)]


def test_archive_lines(spark, tmp_path):
    """Blocks, line ends and broken text do not change the lines."""
    long = ["x" * 1000 + str(i) for i in range(6000)]
    files = {
        "long.csv": "\n".join(long).encode(),
        "dos.csv": b"a,b\r\n1,2\r\n\r\n3,4\r",
        "empty.csv": b"",
        "odd.csv": b"ok\n\xff\xfe\n",
    }
    for name, data in files.items():
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    pack(f"{tmp_path}/a/one.tar.gz", [(n, f"{tmp_path}/{n}") for n in files])
    rows = archives.read_archives(spark, f"{tmp_path}/a/*.tar.gz", batch_rows=100).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        found.setdefault(r.member, []).append((r.line_no, r.line))
    assert found.pop("long.csv") == list(enumerate(long, 1))
    assert found == {
        "dos.csv": [(1, "a,b"), (2, "1,2"), (3, ""), (4, "3,4")],
        "odd.csv": [(1, "ok"), (2, "\ufffd\ufffd")],
    }


def test_materialize(spark, tmp_path):
    path, calls = f"{tmp_path}/result", []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("prefix", F.concat(F.lit("a/"), F.col("id") % 2))

    first = store.materialize(spark, path, build, partition_by="prefix")
    again = store.materialize(spark, path, build, partition_by="prefix")
    assert len(calls) == 1
    assert sorted(first.select("id", "prefix").collect()) == sorted(again.select("id", "prefix").collect())
    store.materialize(spark, path, build, refresh=True)
    assert len(calls) == 2
    os.remove(f"{path}/_SUCCESS")
    assert store.materialize(spark, path, build).count() == 5
    assert len(calls) == 3, "a result without its commit marker is computed again"


def test_settle_freezes_values(spark):
    stored = store.settle(spark.range(10).withColumn("x", F.rand()))
    assert sorted(stored.collect()) == sorted(stored.collect())
    assert stored.inputFiles(), "it is read from files, not computed again"


def test_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "scratch_dir", lambda spark: f"{tmp_path}/scratch")
    store.settle(spark.range(3))
    assert os.listdir(f"{tmp_path}/scratch")
    assert store.clear_scratch(spark) and not os.path.exists(f"{tmp_path}/scratch")


def test_scratch_folder_comes_from_the_session():
    def session(master, setting=None, context_dir=None):
        context = SimpleNamespace(
            master=master, applicationId="app", getCheckpointDir=lambda: context_dir
        )
        conf = SimpleNamespace(get=lambda name, default: setting)
        return SimpleNamespace(sparkContext=context, conf=conf)

    assert store.scratch_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared/runlens-app"
    assert store.scratch_dir(session("yarn", None, "hdfs:///set")) == "hdfs:///set/runlens-app"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.scratch_dir(session("yarn"))


def test_run_logs_store_matches_csv(spark, tree, tmp_path):
    plain = rl.RunLogs(spark, tree, tags={"asym_ratio": r"asym_ratio(\d+)"}, plain_names=True)
    kept = rl.RunLogs(spark, tree, store=f"{tmp_path}/store")
    columns = plain.transactions.columns
    assert sorted(plain.transactions.collect(), key=str) == sorted(
        kept.transactions.select(*columns).collect(), key=str
    )
    assert {(r.config_name, r.asym_ratio) for r in plain.index.collect()} == {
        ("first", 60),
        ("second", None),
    }
    assert [r.clients for r in plain.experiments(clients=[200, 1]).collect()] == [200]
