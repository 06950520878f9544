"""Result frames for figures and tables."""

from pyspark.sql import functions as F

from runlens.functions.paths import config_label
from runlens.operators.facts import as_list, cell


def series(df, condition, x, y, scale=None, config_prefix=None):
    """The rows of one setting in the order of ``x``; ``y`` divided by ``scale`` if given.

    ``config_prefix`` keeps the configurations whose name starts with it.
    """
    rows = df if condition is None else df.where(condition)
    if config_prefix is not None:
        rows = rows.where(F.col("config_name").startswith(config_prefix))
    if scale is not None:
        rows = rows.withColumn(y, F.col(y) / scale)
    return rows.orderBy(x)


def throughput_wide(
    df, configs, index="clients", columns="config_name", value="throughput", labels=None, agg=None
):
    """One column per configuration, one row per client count, named by ``labels``.

    ``index`` may be several columns. Two rows for a cell raise, unless ``agg`` (such as ``F.max``)
    says what to make of them.
    """
    keys = as_list(index)
    wide = df.groupBy(*keys).pivot(columns, list(configs)).agg(cell(value, agg))
    return wide.withColumnsRenamed(labels or {}).orderBy(*keys)


def axis_values(df, col, desc=False):
    """The distinct values of a factor in order."""
    values = df.select(col).distinct()
    return values.orderBy(F.col(col).desc() if desc else F.col(col).asc())


__all__ = ["axis_values", "config_label", "series", "throughput_wide"]
