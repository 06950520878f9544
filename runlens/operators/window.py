"""The part of a run that counts."""

from pyspark.sql import functions as F

from runlens.operators.facts import as_list, attach

NS = 1000000000
FOREVER_S = 1000000000


def trims(start_s, dur_s, upper):
    """Whether the window can drop a row that has a send time."""
    if upper not in ("from_end", "from_start"):
        raise ValueError("upper must be 'from_end' or 'from_start'")
    return start_s > 0 or upper == "from_start" or start_s + dur_s < 0


def machine_spans(txns, keys=("prefix", "machine"), time="sent_at"):
    """Per machine: sent transactions with a send time, first and last send time."""
    return txns.groupBy(*as_list(keys)).agg(
        F.count(time).alias("sent"), F.min(time).alias("first_at"), F.max(time).alias("last_at")
    )


def run_window(
    txns,
    keys=("prefix", "machine"),
    start_s=0,
    dur_s=FOREVER_S,
    upper="from_end",
    time="sent_at",
    spans=None,
):
    """Drop the warm-up of each machine, and rows without a send time.

    A row stays if it was sent at or after the machine's first send time plus ``start_s`` and not
    after the upper bound. The bound counts ``start_s + dur_s`` from the last send time
    (``from_end``, which no row exceeds) or from the first (``from_start``, which cuts the tail).

    First and last send times are aggregated and joined back; pass ``spans`` (a result of
    ``machine_spans`` that is stored) to use ones already computed. A window that drops nothing is
    a plain filter.
    """
    present = txns.where(F.col(time).isNotNull())
    if not trims(start_s, dur_s, upper):
        return present
    keys = as_list(keys)
    stored = spans is not None
    if not stored:
        spans = machine_spans(present, keys, time)
    bounds = attach(present, spans.select(*keys, "first_at", "last_at"), keys, stored=stored)
    base = "last_at" if upper == "from_end" else "first_at"
    return bounds.where(
        (F.col(time) >= F.col("first_at") + start_s * NS)
        & (F.col(time) <= F.col(base) + (start_s + dur_s) * NS)
    ).drop("first_at", "last_at")
