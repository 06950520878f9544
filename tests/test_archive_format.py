"""The data source of archives: the same rows, and filters that reach the archives."""

import os

import pytest
from pyspark.sql import functions as F

from runlens.sources import archive_format, archives
from tests.test_sources import pack


@pytest.fixture
def packed(spark, tree, tmp_path):
    for name in os.listdir(tree):
        for machine in (0, 1):
            source = f"{tree}/{name}/client/{machine}"
            pack(
                f"{tmp_path}/{name}/client/{machine}.tar.gz",
                [(f"./logs/{f}", f"{source}/{f}") for f in os.listdir(source)],
            )
    outer = [(f"{n}.tar.gz", f"{tmp_path}/{n}/client/0.tar.gz") for n in os.listdir(tree)]
    pack(f"{tmp_path}/all/client/study.tar.gz", outer)
    archive_format.register_archives(spark)
    return f"{tmp_path}/*/client/*.tar.gz"


def rows(df):
    return sorted(df.collect(), key=str)


def read(spark, glob, **options):
    return spark.read.format("log_archives").options(**options).load(glob)


def test_same_lines(spark, packed):
    wanted = archives.read_archives(spark, packed)
    found = read(spark, packed, batch_rows=3)
    assert found.columns == wanted.columns and rows(found) == rows(wanted)
    for file in ("transactions.csv", "summary.csv"):
        one = archives.read_archived(spark, packed, file)
        assert rows(archive_format.load_archived(spark, packed, file)) == rows(one)
    assert read(spark, packed.replace("client", "nothing")).count() == 0


def test_filters(spark, packed):
    every = archives.read_archives(spark, packed).cache()
    names = [r.archive for r in every.select("archive").distinct().orderBy("archive").collect()]
    nested = next(x for x in names if "study/" in x)
    member, archive = F.col("member"), F.col("archive")
    for condition in (
        member == "logs/summary.csv",
        member == "summary.csv",
        member.isin("logs/summary.csv", "logs/transactions.csv"),
        member.startswith("logs/s"),
        member.startswith("/logs"),
        member.endswith("ry.csv"),
        member.endswith("/logs/summary.csv"),
        member.contains("s/tr"),
        member.contains("x+(") | (F.col("line_no") == 1),
        member.like("logs%") & member.endswith("summary.csv") & (F.col("line_no") > 1),
        ~member.endswith("summary.csv"),
        archive == names[0],
        archive == nested,
        archive.isin(names[0], nested, "other"),
        archive.startswith(nested[:-3]),
        archive.startswith(names[0][:-9]),
        archive.endswith("1.tar.gz"),
        archive == "nothing",
    ):
        assert rows(read(spark, packed).where(condition)) == rows(every.where(condition)), condition


def test_the_plan_shows_what_is_pushed(spark, packed):
    one = next(x for x in archive_format.list_archives(packed) if x.endswith("/1.tar.gz"))
    found = read(spark, packed).where(
        (F.col("archive") == one) & F.col("member").endswith("summary.csv")
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" not in plan.split("BatchScan")[0], plan
    assert found.rdd.getNumPartitions() == 1 and found.count() > 0
    few = spark.read.format("log_archives").schema("member string, line_no long").load(packed)
    wanted = archives.read_archives(spark, packed).select("member", "line_no")
    assert rows(few) == rows(wanted)


def test_faults(spark, packed):
    with pytest.raises(Exception, match="no columns of an archive"):
        spark.read.format("log_archives").schema("size long").load(packed).collect()
    with pytest.raises(Exception, match="odd"):
        read(spark, "odd://store/*.tar.gz").collect()
