"""Positions and running sums in the order of a group of any size.

An ordered window over a group sorts the whole group in one task. Here a range shuffle by
(keys, order) spreads every group over as many pieces as it needs, each piece is numbered by
itself, and one small table of pieces links them.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators.facts import attach
from runlens.sources.store import settle

_PIECE_BITS = 33  # monotonically_increasing_id holds the row's number below these bits


def in_pieces(df, keys, order):
    """``df`` sorted over the cluster, with the piece (``_piece``) and place (``_pos``) of a row.

    The result is stored, so that all its readers see the same pieces.
    """
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_piece", F.shiftright("_pos", _PIECE_BITS))
    )
    return settle(placed, "ordered", packed=True)


def ranked(df, keys, order):
    """``df`` with ``_rank`` (1, 2, ... in ``order``) and ``_size`` of each group.

    Rows that are equal in all of ``order`` are ranked in any order; add a column that tells them
    apart if many rows can be equal, since equal rows stay in one piece.
    """
    placed = in_pieces(df, keys, order)
    by_key = Window.partitionBy(*keys)
    pieces = (
        placed.groupBy(*keys, "_piece")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first"))
        .withColumn("_before", F.sum("_rows").over(by_key.orderBy("_piece")) - F.col("_rows"))
        .withColumn("_size", F.sum("_rows").over(by_key))
        .drop("_rows")
    )
    return (
        attach(placed, pieces, [*keys, "_piece"])
        .withColumn("_rank", F.col("_pos") - F.col("_first") + F.col("_before") + 1)
        .drop("_pos", "_piece", "_first", "_before")
    )


def spread(df, keys, order):
    """``df`` range-shuffled by (keys, order), stored with the piece (``_piece``) of each row."""
    placed = df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id())
    return settle(placed, "ordered", packed=True)


def accumulated(placed, keys, order, weight):
    """``_upto`` (running sum of ``weight`` in ``order``) and ``_total`` of each group.

    ``placed`` is a result of ``spread`` with the same keys and order.
    """
    by_key = Window.partitionBy(*keys)
    pieces = (
        placed.groupBy(*keys, "_piece")
        .agg(F.sum(weight).alias("_sum"))
        .withColumn("_before", F.sum("_sum").over(by_key.orderBy("_piece")) - F.col("_sum"))
        .withColumn("_total", F.sum("_sum").over(by_key))
        .drop("_sum")
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    running = placed.withColumn(
        "_running", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        attach(running, pieces, [*keys, "_piece"])
        .withColumn("_upto", F.col("_before") + F.col("_running"))
        .drop("_piece", "_before", "_running")
    )


def value_counts(df, keys, x):
    """How often (``_count``) each value of ``x`` occurs in its group, nulls left out."""
    return df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_count"))
