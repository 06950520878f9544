"""Reproducible draws."""

from pyspark.sql import functions as F


def draw(keys, seed=0):
    """A number in [0, 1) that depends on ``keys`` (a column or several) and ``seed`` alone.

    It is the same in every run, partitioning and retry, and plain SQL can compute it. It moves in
    steps of 2**-52, fine enough for strata of any size.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in names]
    text = F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *parts))
    head = F.substring(F.md5(text), 1, 13)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(1 << 52)
