"""Distributions and series against brute force, with heavy keys, heavy values and many pieces."""

import math
import os
import shutil
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import runlens as rl
from runlens.functions.sampling import draw
from runlens.operators import stats
from runlens.operators.ordering import accumulated, in_pieces, ranked, spread
from runlens.plans import studies
from runlens.sources import store


@pytest.fixture(scope="module")
def pieces(spark):
    """Keep the small test groups in several pieces."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark, pieces):
    """Key "hot" has most rows and a third of them share one value; some values are null."""
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(3000) < 0.6, "hot", rng.choice(list("abcdef"), 3000))
    x = np.where(rng.random(3000) < 0.33, 5.0, np.round(rng.lognormal(2, 1, 3000), 1))
    pdf = pd.DataFrame({"key": keys, "id": np.arange(3000), "x": x})
    pdf.loc[pdf.index % 97 == 0, "x"] = None
    pdf = pd.concat([pdf, pd.DataFrame({"key": ["one"], "id": [3000], "x": [4.0]})])
    df = spark.createDataFrame(pdf.astype({"id": "int64"}))
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)
    return df, pdf.dropna()


def test_groups_span_pieces(skewed):
    df, _ = skewed
    placed = in_pieces(df.where("x is not null"), ["key"], ["x", "id"])
    assert placed.where("key = 'hot'").select("_piece").distinct().count() > 2


def test_ranked(skewed):
    df, pdf = skewed
    rows = ranked(df.where("x is not null"), ["key"], ["x", "id"]).toPandas()
    for key, group in pdf.groupby("key"):
        order = group.sort_values(["x", "id"]).id.tolist()
        got = rows[rows.key == key]
        assert got.sort_values("_rank").id.tolist() == order
        assert sorted(got["_rank"]) == list(range(1, len(order) + 1))
        assert set(got._size) == {len(order)}


def test_accumulated(skewed):
    df, pdf = skewed
    weighted = df.where("x is not null").withColumn("w", F.col("id") % 5)
    placed = spread(weighted, ["key"], ["x", "id"])
    rows = accumulated(placed, ["key"], ["x", "id"], "w").toPandas()
    for key, group in pdf.groupby("key"):
        group = group.sort_values(["x", "id"])
        got = rows[rows.key == key].sort_values(["x", "id"])
        assert got._upto.tolist() == (group.id % 5).cumsum().tolist()
        assert set(got._total) == {(group.id % 5).sum()}


@pytest.mark.parametrize("tiebreak", [None, "id"])
def test_cdf(skewed, tiebreak):
    df, pdf = skewed
    rows = rl.cdf(df, "key", "x", tiebreak)
    assert rows.columns == ["key", "x"] + [tiebreak] * bool(tiebreak) + ["y"]
    rows = rows.toPandas()
    for key, group in pdf.groupby("key"):
        x = np.sort(group.x)
        y = np.arange(1, len(x) + 1) / len(x)
        got = rows[rows.key == key]
        assert Counter(zip(got.x, got.y)) == Counter(zip(x, y))


def test_cdf_of_whole_table(skewed):
    df, pdf = skewed
    rows = rl.cdf(df, [], "x").toPandas()
    x = np.sort(pdf.x)
    assert Counter(zip(rows.x, rows.y)) == Counter(zip(x, np.arange(1, len(x) + 1) / len(x)))


def test_cdf_of_a_value_in_many_rows(spark):
    df = spark.range(25_001).select((F.col("id") > 25_000 - 10).cast("int").alias("x"))
    rows = rl.cdf(df, [], "x")
    assert rows.count() == 25_001
    assert rows.where("x = 0").agg(F.max("y")).first()[0] == 24_991 / 25_001
    assert rows.select("y").distinct().count() == 25_001


def test_stored_copies(spark, skewed):
    """A distribution and the gaps store one copy of their rows, deleted by ``scratch``."""
    df, _ = skewed
    base = store.scratch_dir(spark).removeprefix("file://").removeprefix("file:")
    listed = lambda: set(os.listdir(base)) if os.path.isdir(base) else set()
    for call in (lambda: rl.cdf(df, "key", "x"), lambda: rl.gaps(df, "key", "x")):
        before = listed()
        with rl.scratch(spark):
            assert call().count() > 0
            made = sorted(name.split("-")[0] for name in listed() - before)
            assert made == ["facts", "ordered"]
        assert listed() == before


def test_exact_percentiles(skewed):
    df, pdf = skewed
    rows = rl.percentiles(df, "key", "x", (0.01, 0.5, 0.999), method="exact").toPandas()
    assert list(rows.columns) == ["key", "p1", "p50", "p99.9"]
    for key, group in pdf.groupby("key"):
        x = np.sort(group.x)
        got = rows[rows.key == key].iloc[0]
        for p, name in ((0.01, "p1"), (0.5, "p50"), (0.999, "p99.9")):
            assert got[name] == x[max(math.ceil(p * len(x)), 1) - 1]


def test_approximate_percentiles_of_small_groups_are_exact(skewed):
    df, _ = skewed
    exact = rl.percentiles(df, "key", "x", method="exact")
    near = rl.percentiles(df, "key", "x")
    assert sorted(exact.collect()) == sorted(near.collect())
    with pytest.raises(ValueError):
        rl.percentiles(df, "key", "x", method="guess")


def test_percentiles_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "key string, x double")
    found = {r.key: r.p50 for r in rl.percentiles(df, "key", "x").collect()}
    assert found == {"a": None, "b": 1.0}
    assert rl.percentiles(df, "key", "x", method="exact").collect() == [("b", 1.0, 1.0, 1.0, 1.0)]


def test_exact_percentiles_of_a_large_group(spark):
    df = spark.range(0, 300_000, 1, 16).withColumn("x", (F.col("id") - 100_000) * 1.0)
    row = rl.percentiles(df, [], "x", (0.0, 0.25, 0.5, 0.9, 1.0), method="exact").first()
    assert list(row) == [-100_000, -25_001, 49_999, 169_999, 199_999]
    odd = spark.createDataFrame([(x,) for x in (float("-inf"), -2.5, 0.0, 0.0, 3e300, float("inf"))], "x double")
    assert rl.percentiles(odd, [], "x", (0.1, 0.3, 0.5, 0.8, 1.0), method="exact").first() == (
        float("-inf"), -2.5, 0.0, 3e300, float("inf"),
    )


def test_draws_are_fine_and_keyed_by_several_columns(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("run"))
    one = df.select(draw("id", 3).alias("d"), draw(["run", "id"], 3).alias("e")).collect()
    assert len({r.d for r in one}) == 2000 and all(0 <= r.d < 1 for r in one)
    assert any(r.d * 2**33 % 1 for r in one) and [r.d for r in one] != [r.e for r in one]
    same = df.select(draw(["run", "id"], 3).alias("e")).collect()
    assert [r.e for r in one] == [r.e for r in same]


def test_box_stats(skewed):
    df, pdf = skewed
    rows = rl.box_stats(df, "key", "x").toPandas().set_index("key")
    for key, group in pdf.groupby("key"):
        x = group.x.to_numpy()
        q1, median, q3 = np.percentile(x, [25, 50, 75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = x[(x >= low) & (x <= high)]
        got = rows.loc[key]
        assert (got.n, got.low, got.high) == (len(x), x.min(), x.max())
        assert np.allclose([got.q1, got["median"], got.q3], [q1, median, q3])
        assert got.whisker_low == min(inside.min(), q1)
        assert got.whisker_high == max(inside.max(), q3)
        assert got.outliers == len(x) - len(inside)


def test_box_stats_of_whole_table(skewed):
    df, pdf = skewed
    row = rl.box_stats(df, [], "x").first()
    assert (row.n, row.median) == (len(pdf), np.median(pdf.x))
    counts = df.withColumn("count", F.col("x"))
    assert rl.box_stats(counts, "key", "count").count() == pdf.key.nunique()


@pytest.mark.parametrize("drop_first", [True, False])
def test_gaps(skewed, drop_first):
    df, pdf = skewed
    rows = rl.gaps(df, "key", "x", "id", drop_first).toPandas()
    assert list(rows.columns) == ["key", "id", "x", "gap"]
    for key, group in pdf.groupby("key"):
        series = group.sort_values(["x", "id"])
        gap = series.x.shift(-1) - series.x
        wanted = dict(zip(series.id, gap))
        if drop_first:
            wanted.pop(series.id.iloc[0])
        got = dict(zip(rows[rows.key == key].id, rows[rows.key == key].gap))
        assert got.keys() == wanted.keys()
        for i, value in wanted.items():
            assert got[i] == value or (math.isnan(got[i]) and math.isnan(value))


def test_gaps_with_ties_and_no_tiebreak(skewed):
    df, pdf = skewed
    rows = rl.gaps(df.select("key", "x"), "key", "x", drop_first=False).toPandas()
    hot = np.sort(pdf[pdf.key == "hot"].x)
    got = np.sort(rows[rows.key == "hot"].gap.dropna())
    assert np.allclose(got, np.sort(np.diff(hot)))


def test_shift_and_scale(skewed):
    df, pdf = skewed
    low, high = pdf.groupby("key").x.min(), pdf.groupby("key").x.max()
    for r in rl.shift_to_zero(df, "key", "x").where("x is not null").collect()[:200]:
        assert r.x == pytest.approx(pdf.set_index("id").loc[r.id].x - low[r.key])
    scaled = rl.min_max_scale(df, "key", "x").collect()
    assert len(scaled) == 3001, "rows with a null stay"
    for r in scaled[:200]:
        if r.x is not None:
            value = pdf.set_index("id").loc[r.id].x
            assert r.x == pytest.approx((value - low[r.key]) / (high[r.key] - low[r.key]))
    assert [r.x for r in scaled if r.key == "one"] == [None], "all values equal"
    whole = rl.shift_to_zero(df, [], ["x", "id"]).agg(F.min("x"), F.min("id")).first()
    assert tuple(whole) == (0.0, 0)


def test_drop_constant_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", None, None, 1.0, [1]), (1, "b", None, 2, 1.0, [1])],
        "one int, two string, nothing int, some int, kept double, list array<int>",
    )
    assert rl.drop_constant_columns(df, ignore="kept").columns == ["two", "some", "kept"]
    assert rl.drop_constant_columns(df.limit(0)).columns == df.columns


def test_sampling(spark):
    df = spark.range(20000).withColumn("s", F.when(F.col("id") < 150, "few").otherwise("many"))
    first = rl.sample_rows(df, 0.1, "id")
    assert first.count() == rl.sample_rows(df.repartition(3), 0.1, "id").count()
    assert abs(first.count() - 2000) < 200
    other = rl.sample_rows(df, 0.1, "id", seed=1)
    assert first.join(other, "id").count() < 400, "another seed is another sample"
    assert rl.sample_rows(df, 0.1).count() == rl.sample_rows(df, 0.1).count()
    for key in ("id", None):
        counts = dict(map(tuple, rl.stratified_sample(df, "s", 200, key).groupBy("s").count().collect()))
        assert counts["few"] == 150, "a small stratum stays whole"
        assert abs(counts["many"] - 200) < 60


def test_frames(spark):
    df = spark.createDataFrame(
        [("first.conf", 10, 5, 2000.0), ("first-b.conf", 5, 5, 1000.0), ("second.conf", 10, 5, 500.0)],
        "config_name string, clients int, wl_hot int, throughput double",
    )
    rows = rl.series(df, F.col("wl_hot") == 5, "clients", "throughput", 1000, "first").collect()
    assert [(r.clients, r.throughput) for r in rows] == [(5, 1.0), (10, 2.0)]
    wide = rl.throughput_wide(df, ["first.conf", "second.conf"], labels={"first.conf": "First"})
    assert wide.columns == ["clients", "First", "second.conf"]
    twice = df.unionByName(df.withColumn("throughput", F.col("throughput") + 1))
    with pytest.raises(Exception, match="several rows"):
        rl.throughput_wide(twice, ["first.conf"]).collect()
    best = rl.throughput_wide(twice, ["first.conf"], agg=F.max).collect()
    assert [tuple(r) for r in best] == [(5, None), (10, 2001.0)]
    assert [tuple(r) for r in wide.collect()] == [(5, None, None), (10, 2000.0, 500.0)]
    assert [r.clients for r in rl.axis_values(df, "clients", desc=True).collect()] == [10, 5]


def test_percentiles_of_roll_ups_from_stored_bins(spark, skewed):
    df, _ = skewed
    df = rl.settle(df.withColumns({"half": F.col("id") % 2, "odd": F.lit(1)}))
    parts = [stats.value_bins(df.where(F.col("id") % 3 == k), ["key", "half"], "x") for k in range(3)]
    bins = rl.settle(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    for keys in (["key", "half"], ["key"], ["half"], []):
        found = rl.percentiles(df, keys, "x", (0.01, 0.5, 0.999), method="exact", bins=bins)
        plain = rl.percentiles(df, keys, "x", (0.01, 0.5, 0.999), method="exact")
        assert sorted(found.collect()) == sorted(plain.collect())
    with pytest.raises(ValueError, match="exact"):
        rl.percentiles(df, "key", "x", bins=bins)


def test_stored_bins_spare_the_first_scan(spark, monkeypatch):
    """With bins the log is read once, for the values in the wanted bins."""
    rows = spark.range(0, 50_000, 1, 4)
    df = rl.settle(rows.select((F.col("id") % 3).alias("key"), (F.col("id") * 1.0).alias("x")))
    bins = rl.settle(stats.value_bins(df, "key", "x"))
    plain = rl.percentiles(df, "key", "x", method="exact").collect()
    read = []
    monkeypatch.setattr(stats, "_with_bins", lambda *args, f=stats._with_bins: read.append(1) or f(*args))
    assert sorted(rl.percentiles(df, "key", "x", method="exact", bins=bins).collect()) == sorted(plain)
    assert len(read) == 1
    rl.percentiles(df, "key", "x", method="exact")
    assert len(read) == 3


def test_bins_in_a_store_follow_the_logs(spark, tree, tmp_path):
    root, kept = f"{tmp_path}/logs", f"{tmp_path}/store"
    shutil.copytree(tree, root)
    first = rl.RunLogs(spark, root, store=kept)
    assert first.latency_bins.agg(F.sum("_n")).first()[0] == 10
    shutil.copytree(f"{root}/base-sz19", f"{root}/later-sz3")
    logs = rl.RunLogs(spark, root, store=kept)
    found = studies.latency_study(logs, method="exact")
    plain = studies.latency_study(rl.RunLogs(spark, root), method="exact")
    assert sorted(found.select(*plain.columns).collect()) == sorted(plain.collect())
    assert found.count() == 3
    one = studies.latency_study(logs, method="exact", clients=200)
    assert one.count() == 1 and one.first()["p50"] == [r for r in plain.collect() if r.clients == 200][0]["p50"]


def test_gaps_of_equal_rows_spread_over_pieces(spark, monkeypatch):
    n = 1_000_000
    rows = spark.range(0, n, 1, 8).select(F.lit("a").alias("key"), F.lit(5).alias("t"))
    rows = rows.unionByName(spark.createDataFrame([("a", 1), ("a", 9), ("b", 5)], "key string, t int"))
    sizes = []
    place = stats.in_pieces

    def seen(*args):
        placed = place(*args)
        sizes.extend(r["n"] for r in placed.groupBy("_piece").agg(F.sum("_n").alias("n")).collect())
        return placed

    monkeypatch.setattr(stats, "in_pieces", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rl.gaps(rows, "key", "t", drop_first=False)
        counts = {(r.key, r.t, r.gap): r["count"] for r in found.groupBy("key", "t", "gap").count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counts == {("a", 1, 4): 1, ("a", 5, 0): n - 1, ("a", 5, 4): 1, ("a", 9, None): 1, ("b", 5, None): 1}
    assert len(sizes) == 8 and max(sizes) < n / 4
    per_task = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < n / 3


def test_gaps_of_rows_that_cannot_be_grouped(spark):
    rows = [("a", t, {"k": t}) for t in (1, 1, 1, 4)] * 2
    df = spark.createDataFrame(rows, "key string, t int, note map<string,int>")
    found = rl.gaps(df, "key", "t", drop_first=False)
    assert sorted((r.t, r.gap) for r in found.collect() if r.gap is not None) == [(1, 0)] * 5 + [(1, 3), (4, 0)]
    assert found.columns == ["key", "t", "note", "gap"] and found.count() == 8


def test_gaps_without_the_first_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("a", 2)] + [("b", 7)], "key string, t int")
    found = sorted(rl.gaps(df, "key", "t").collect(), key=str)
    assert found == [("a", 1, 0), ("a", 1, 1), ("a", 2, None)]
