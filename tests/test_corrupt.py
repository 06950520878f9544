"""Lines that the readers cannot read, held against what the readers make of them."""

from pyspark.sql import functions as F

from runlens.sources import corrupt, logs
from tests.conftest import TXN_HEADER, write

GOOD = "1,16777216,1;0,2;1,0,0,9;4,1000000000,1005000000"


def lines_of(spark, tmp_path, *lines, name="transactions", header=TXN_HEADER, **options):
    side, file = logs.FILES[name]
    write(f"{tmp_path}/e/{side}/0-0/{file}", header, *lines)
    rows = corrupt.corrupt_lines(spark, str(tmp_path), name, **options)
    return {r["record"]: r["reasons"] for r in rows.collect()}


def test_faults_of_fields_and_lines(spark, tmp_path):
    found = lines_of(
        spark, tmp_path, GOOD,
        "2,33554432,2,0,0,1,,,",  # empty fields are nulls
        "x,1,1;x,,0,0,7,21000000000,21001000000",
        "4,99999999999,0,1,0.5,0,7,1.5,9s",
        "5,0,0",
        "6,0,0,1,0,0,7,1,2,3",
    )
    assert found == {
        "x,1,1;x,,0,0,7,21000000000,21001000000": ["txn_id: no bigint", "regions: no number in the list"],
        "4,99999999999,0,1,0.5,0,7,1.5,9s": [
            "coordinator: no int", "generator: no bigint", "received_at: no double"
        ],
        "5,0,0": ["number of fields"],
        "6,0,0,1,0,0,7,1,2,3": ["number of fields"],
    }


def test_reasons_are_the_nulls_of_the_reader(spark, tmp_path):
    values = ["7", "+7", "-7", "1.5", "1e3", "abc", "99999999999999999999", "0x1", "", " 5", "5 "]
    rows = [f"{v},{v},{i},0,0" for i, v in enumerate(values)]
    header = "txn_id,event,time,machine,home"
    found = lines_of(spark, tmp_path, *rows, name="client_events", header=header)
    faulty = {int(record.split(",")[2].split(".")[0]) for record in found}
    read = logs.read_client_events(spark, str(tmp_path)).select(F.col("time").cast("int"), "txn_id").collect()
    null = {r["time"] for r in read if r["txn_id"] is None} - {values.index("")}
    assert faulty == null


def test_counts_per_file_and_log(spark, tree):
    found = corrupt.corrupt_counts(spark, tree).collect()
    assert {(r["log"], r["reason"], r["n"]) for r in found} == {
        ("transactions", "regions: no number in the list", 1),
        ("txn_timestamps", "txn_timestamp: no bigint", 1),
    }
    assert len({r["file"] for r in found}) == len(found)
    assert corrupt.corrupt_counts(spark, tree, names=["deadlocks"]).count() == 0


def test_old_layouts(spark, tmp_path):
    found = lines_of(
        spark, tmp_path, "1,x,2", "1,2,3", name="deadlocks", header="time,partition,replica",
        layout="time long, partition int, replica int",
    )
    assert found == {"1,x,2": ["partition: no int"]}
