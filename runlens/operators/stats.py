"""T1 to T6 and the percentiles: distributions, scaling, box statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from runlens.operators.facts import as_list, attach, with_facts
from runlens.operators.ordering import (
    accumulated,
    in_pieces,
    ranked,
    spread,
    value_counts,
)

DEFAULT_ACCURACY = 10000


def percentile_names(probs, prefix="p"):
    return [f"{prefix}{100 * p:g}" for p in probs]


def percentiles(
    df,
    keys,
    value,
    probs=(0.5, 0.9, 0.95, 0.99),
    accuracy=DEFAULT_ACCURACY,
    prefix="p",
    method="approx",
    bins=None,
):
    """M9: percentiles of ``value`` per key, one column each (``p50``, ``p90``, ...).

    ``approx`` keeps a summary of bounded size per key. The rank error is below
    rows / ``accuracy``, so it is exact while a key has fewer rows than ``accuracy``.

    ``exact`` finds the smallest value with at least that share of the rows at or below it, for
    keys of any size and alike in every run; a key without a value gets no row. ``df`` is read
    twice: counts per bin tell in which bins the wanted ranks lie, and only the values of these
    bins are ordered. With ``bins``, a stored result of ``value_bins`` on the same rows, the counts
    are added up from there and ``df`` is read once.
    """
    keys, probs = as_list(keys), list(probs)
    names = percentile_names(probs, prefix)
    if method == "exact":
        return _exact_percentiles(df, keys, value, probs, names, bins)
    if bins is not None:
        raise ValueError("bins serve the exact method")
    if method != "approx":
        raise ValueError("method must be 'approx' or 'exact'")
    found = df.groupBy(*keys).agg(F.percentile_approx(value, probs, accuracy).alias("_found"))
    return found.select(*keys, *[F.col("_found")[i].alias(n) for i, n in enumerate(names)])


def _bin(value):
    """A whole number that never falls as the value grows; a bin spans less than one percent."""
    x = F.col(value).cast("double")
    finite = F.when(F.abs(x) < float("inf"), F.abs(x))
    size = F.floor(F.ln(F.when(finite > 0, finite)) * 128).cast("long") + 100_000
    size = F.coalesce(size, F.lit(1_000_000))
    return F.when(F.isnan(x), 2_000_000).when(x == 0, 0).when(x > 0, size).otherwise(-size)


def _with_bins(df, keys, value):
    return df.where(F.col(value).isNotNull()).select(*keys, value, _bin(value).alias("_bin"))


def value_bins(df, keys, value):
    """How many values of each key lie in each bin: keys, ``_bin`` and ``_n``.

    A table of bounded size (a bin spans less than one percent of its values) from which exact
    percentiles for these keys, or any coarser ones, start without a scan (``percentiles(...,
    bins=)``). Counts of parts of a log, or of new experiments, are appended; they add up.
    """
    keys = as_list(keys)
    return _with_bins(df, keys, value).groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))


def _exact_percentiles(df, keys, value, probs, names, bins=None):
    valued = _with_bins(df, keys, value)
    by_key = Window.partitionBy(*keys)  # over bins, of which a key has a bounded number
    bins = (
        (value_bins(df, keys, value) if bins is None else bins)
        .groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_to", F.sum("_n").over(by_key.orderBy("_bin")))
        .withColumn("_all", F.sum("_n").over(by_key))
    )
    wanted = [
        F.min(
            F.when(
                F.col("_to") >= F.col("_all") * p,
                F.struct("_bin", (F.col("_to") - F.col("_n")).alias("_below"), "_all"),
            )
        )
        for p in probs
    ]
    places = (
        bins.groupBy(*keys)
        .agg(F.array_distinct(F.array(*wanted)).alias("_places"))
        .select(*keys, F.explode("_places").alias("_place"))
        .select(*keys, "_place.*")
    )
    inside = attach(valued, places, [*keys, "_bin"])
    by = [*keys, "_bin", "_below", "_all"]
    placed = accumulated(spread(value_counts(inside, by, value), by, [value]), by, [value], "_count")
    rank = F.col("_below") + F.col("_upto")
    return placed.groupBy(*keys).agg(
        *[
            F.min(F.when(rank >= F.col("_all") * p, F.col(value))).alias(name)
            for p, name in zip(probs, names)
        ]
    )


def _points(counted):
    """The rows of counted values again, numbered by ``_rank``, in chunks of a bounded size."""
    chunk = 10_000
    first = F.col("_upto") - F.col("_count")
    some = counted.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_count") - 1) / F.lit(chunk))))
    )
    low = first + F.col("_chunk") * chunk + 1
    high = F.least(first + (F.col("_chunk") + 1) * chunk, F.col("_upto"))
    return some.withColumn("_rank", F.explode(F.sequence(low, high)))


def cdf(df, keys, x, tiebreak=None):
    """The empirical distribution of ``x`` per key: sorted values and ``y`` = i / n.

    Every row gives one point, so equal values have several; nulls give none. Equal values are
    counted before they are ordered and expanded at the end. ``tiebreak`` (a column or list) fixes
    the order of equal values and is kept in the result. One copy of the values is stored.
    """
    keys, ties = as_list(keys), as_list(tiebreak)
    if ties:
        values = df.where(F.col(x).isNotNull()).select(*keys, x, *ties)
        placed = ranked(values, keys, [x, *ties]).withColumnRenamed("_size", "_total")
    else:
        values = spread(value_counts(df, keys, x), keys, [x])
        placed = _points(accumulated(values, keys, [x], "_count"))
    return placed.select(*keys, x, *ties, (F.col("_rank") / F.col("_total")).alias("y"))


def shift_to_zero(df, keys, cols):
    """Columns minus their smallest value (nulls ignored) in the group or the whole table.

    ``df`` is read twice; ``settle`` it first if it is costly to compute.
    """
    cols = as_list(cols)
    shifted = with_facts(df, as_list(keys), {f"_min_{c}": F.min(c) for c in cols})
    return shifted.withColumns({c: F.col(c) - F.col(f"_min_{c}") for c in cols}).drop(
        *[f"_min_{c}" for c in cols]
    )


def min_max_scale(df, keys, col):
    """T4: (x - min) / (max - min) in the group; null where all values are equal.

    ``df`` is read twice; ``settle`` it first if it is costly to compute.
    """
    scaled = with_facts(df, as_list(keys), {"_min": F.min(col), "_max": F.max(col)})
    share = F.try_divide(F.col(col) - F.col("_min"), F.col("_max") - F.col("_min"))
    return scaled.withColumn(col, share).drop("_min", "_max")


def drop_constant_columns(df, ignore=None):
    """T5: drop the columns with one distinct value; null is a value of its own.

    One pass over the table, which returns a single row to name the columns. An empty table loses
    nothing.
    """
    checked = [c for c in df.columns if c not in as_list(ignore)]
    if not checked:
        return df
    is_constant = [
        (
            (F.count(F.lit(1)) > 0)
            & (
                (F.count(c) == 0)
                | ((F.count(c) == F.count(F.lit(1))) & F.min(c).eqNullSafe(F.max(c)))
            )
        ).alias(f"_{i}")
        for i, c in enumerate(checked)
    ]
    row = df.agg(*is_constant).first()
    return df.drop(*[c for i, c in enumerate(checked) if row[f"_{i}"]])


def box_stats(df, keys, x, whisker=1.5):
    """The numbers of a box plot per key.

    Quartiles are interpolated; a whisker ends at the last value within ``whisker`` times the
    quartile distance, and values beyond are outliers. Works on counted values, so that repeated
    values are combined before they are moved.
    """
    keys = as_list(keys)
    values = spread(value_counts(df, keys, x), keys, [x])
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    spots = {q: (F.col("_total") - 1) * p for q, p in quartiles.items()}

    def value_at(spot):
        here = (F.col("_upto") - F.col("_count") <= spot) & (spot < F.col("_upto"))
        return F.max(F.when(here, F.col(x)))

    ends = [F.max("_total").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")]
    for q, spot in spots.items():
        ends.append(value_at(F.floor(spot)).alias(f"_{q}_a"))
        ends.append(value_at(F.ceil(spot)).alias(f"_{q}_b"))
        ends.append((F.max(spot) - F.floor(F.max(spot))).alias(f"_{q}_part"))
    boxes = accumulated(values, keys, [x], "_count").groupBy(*keys).agg(*ends)
    boxes = boxes.select(
        *keys,
        "n",
        "low",
        "high",
        *[
            (F.col(f"_{q}_a") + (F.col(f"_{q}_b") - F.col(f"_{q}_a")) * F.col(f"_{q}_part")).alias(q)
            for q in quartiles
        ],
    )
    reach = (F.col("q3") - F.col("q1")) * whisker
    below, above = F.col(x) < F.col("q1") - reach, F.col(x) > F.col("q3") + reach
    facts = ["n", "low", "high", *quartiles]
    return (
        attach(values.select(*keys, x, "_count"), boxes, keys)
        .groupBy(*keys, *facts)
        .agg(
            F.min(F.when(~below, F.col(x))).alias("_low"),
            F.max(F.when(~above, F.col(x))).alias("_high"),
            F.sum(F.when(below | above, F.col("_count")).otherwise(0)).alias("outliers"),
        )
        .select(
            *keys,
            *facts,
            F.least("_low", "q1").alias("whisker_low"),
            F.greatest("_high", "q3").alias("whisker_high"),
            "outliers",
        )
    )


_CHUNK = 10_000  # how many equal rows are one row until the end


def _runs(df):
    """Equal rows as one row per ``_CHUNK`` of them (``_chunk``), with their number (``_n``).

    Without a way to group by its columns (a variant, say) each row stays one.
    """
    kinds = (MapType, VariantType)
    if any(isinstance(f.dataType, kinds) for f in df.schema.fields):
        return df.withColumns({"_n": F.lit(1).cast("long"), "_chunk": F.lit(0).cast("long")})
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_all"))
    last = F.floor((F.col("_all") - 1) / _CHUNK)
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    size = F.least(F.lit(_CHUNK), F.col("_all") - F.col("_chunk") * _CHUNK)
    return chunks.withColumn("_n", size.cast("long")).drop("_all")


def gaps(df, keys, t, tiebreak=None, drop_first=True):
    """The time from each row to the next of its series (``gap``), null at the end.

    ``drop_first`` leaves out the earliest row of each series. Rows without a time are left out.
    Without ``tiebreak`` rows of one time are ordered by a hash of their columns. Equal rows are
    counted before they are ordered and expanded at the end, in chunks of a bounded size that are
    dealt over the tasks, so that any number of them does no harm. One copy of the rows is stored.
    """
    keys, ties = as_list(keys), as_list(tiebreak)
    runs = _runs(df.where(F.col(t).isNotNull()))
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    salted = runs.withColumn("_salt", F.xxhash64(*hashed))
    placed = in_pieces(salted, keys, [t, *ties, "_salt", "_chunk"]).drop("_salt", "_chunk")
    by_key = Window.partitionBy(*keys)
    pieces = (
        placed.groupBy(*keys, "_piece")
        .agg(F.min("_pos").alias("_first"), F.min(t).alias("_head"))
        .withColumn("_next_head", F.lead("_head").over(by_key.orderBy("_piece")))
        .withColumn("_first", F.min("_first").over(by_key))
        .drop("_head")
    )
    following = F.lead(t).over(Window.partitionBy(*keys, "_piece").orderBy("_pos"))
    series = attach(placed.withColumn("_next", following), pieces, [*keys, "_piece"])
    if drop_first:
        left = F.when(F.col("_pos") == F.col("_first"), F.col("_n") - 1).otherwise(F.col("_n"))
        series = series.withColumn("_n", left).where("_n > 0")
    # The last of equal rows is followed by another time, the others by themselves.
    series = series.withColumn("_next", F.coalesce("_next", "_next_head"))
    if not placed.where("_n > 1").isEmpty():
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        series = series.repartition(tasks, "_pos")
        series = series.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        series = series.withColumn("_next", F.when(F.col("_i") < F.col("_n"), F.col(t)).otherwise(F.col("_next")))
    gap = F.col("_next") - F.col(t)
    return series.select(*[c for c in df.columns], gap.alias("gap"))
