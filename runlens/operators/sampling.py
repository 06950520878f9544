"""Samples of rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from runlens.functions.sampling import draw
from runlens.operators.facts import as_list, with_facts


def sample_rows(df, fraction, key=None, seed=0):
    """Keep each row with probability ``fraction``.

    With ``key`` (a column or several) the choice depends on these and the seed alone, so it is the
    same in every run; without it Spark's own sampler is used.
    """
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.where(draw(key, seed) < fraction)


def stratified_sample(df, strata, n, key=None, seed=1000):
    """Thin each stratum to about ``n`` rows; a stratum with no more than that stays whole.

    Rows of a stratum are kept with probability n / size. ``key`` works as in ``sample_rows``.
    """
    chance = F.rand(seed) if key is None else draw(key, seed)
    sized = with_facts(df, as_list(strata), {"_rows": F.count(F.lit(1))})
    return sized.where(chance < F.least(F.lit(1.0), n / F.col("_rows"))).drop("_rows")


def fixed_sample(df, strata, n, key, seed=1000, salts=64):
    """T11 with exact sizes: the ``n`` rows of each stratum whose draws are smallest.

    A stratum of fewer rows stays whole. The draw depends on ``key`` and the seed alone, so a
    stratum's sample is uniform, the same in every run, and grows by adding rows as ``n`` does;
    rows that agree in the key are told apart by their columns.

    One scan, and no count of the strata first: a task passes on at most ``n`` rows of a stratum
    (Spark limits groups before the shuffle up to ``spark.sql.optimizer.windowGroupLimitThreshold``
    rows, 1000 by default), these meet in ``salts`` groups a stratum, and only ``salts * n`` rows
    meet in one task, whatever the stratum's size.
    """
    strata = as_list(strata)
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    drawn = df.withColumns(
        {"_draw": draw(key, seed), "_row": F.xxhash64(*plain), "_salt": F.spark_partition_id() % salts}
    )
    for group in ([*strata, "_salt"], strata):
        order = Window.partitionBy(*group).orderBy("_draw", "_row")
        drawn = drawn.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
    return drawn.drop("_draw", "_row", "_salt", "_place")
