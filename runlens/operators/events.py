"""Time between pairs of events."""

from pyspark.sql import functions as F

from runlens.functions.columns import txn_class
from runlens.operators.facts import as_list, attach, run_keys
from runlens.operators.stats import gaps

__all__ = [
    "diff_series",
    "event_diff",
    "event_diff_server",
    "event_pairs",
    "event_states",
    "events_latency",
    "gaps",
    "hop_diff",
    "merged_states",
    "pairs_of",
    "region_counts",
    "slow_events",
    "txn_facts",
]


def _pair(events, keys, start, end, aggs):
    """Aggregates of the start and the end event side by side; groups with both sides only.

    Events without one of the keys are left out too. ``aggs`` maps an output column to
    (aggregate, event, column). One pass over the two events.
    """
    sides = [
        how(F.when(F.col("event") == event, F.col(col))).alias(name)
        for name, (how, event, col) in aggs.items()
    ]
    return (
        events.where(F.col("event").isin(start, end))
        .groupBy(*keys)
        .agg(*sides)
        .dropna(subset=[*keys, *aggs])
    )


def _last_times(events, keys, start, end, names):
    return _pair(
        events, keys, start, end, {names[0]: (F.max, start, "time"), names[1]: (F.max, end, "time")}
    )


def events_latency(events, start, end, name=None, keys=None):
    """Ms from the last ``start`` to the last ``end`` event of each transaction and machine.

    ``keys`` are the transaction and machine, with the experiment if the events know it.
    """
    keys = run_keys(events) + ["txn_id", "machine"] if keys is None else as_list(keys)
    pairs = _last_times(events, keys, start, end, ["_from", "_to"])
    diff = ((F.col("_to") - F.col("_from")) / 1000000).alias(name or f"{start}_to_{end}")
    return pairs.select(*keys, diff)


def _diff(events, keys, start, end):
    pairs = _last_times(events, keys, start, end, ["from", "to"])
    return pairs.withColumn("diff", (F.col("to") - F.col("from")) / 1000000)


def txn_facts(txns, keys=("txn_id",)):
    """The facts of a transaction that the breakdowns carry.

    The coordinator's region is the machine that sent the transaction.
    """
    facts = txn_class(txns).withColumn("coordinator_region", F.col("machine").cast("int"))
    dropped = {"sent_at", "received_at", "machine"}
    return facts.select(*keys, *[c for c in facts.columns if c not in dropped | set(keys)])


def event_diff(events, txns, start, end, by_home=False, by_machine=True, keys=None):
    """Ms between two events per transaction [and home] [and machine], with the transaction.

    ``keys`` tell transactions apart: their id, with the experiment if both tables know it. The
    facts of a transaction repeat for each of its homes and machines.
    """
    keys = run_keys(events, txns) + ["txn_id"] if keys is None else as_list(keys)
    by = keys + ["home"] * by_home + ["machine"] * by_machine
    return _diff(events, by, start, end).join(txn_facts(txns, keys), keys)


def event_diff_server(events, start, end, by_region=False, by_partition=True, keys=None):
    """Ms between two events of the servers per transaction [and region] [and partition]."""
    keys = run_keys(events) + ["txn_id"] if keys is None else as_list(keys)
    by = keys + ["region"] * by_region + ["partition"] * by_partition
    return _diff(events, by, start, end)


def hop_diff(events, txns, start, end, region, keys=None):
    """Ms between the first ``start`` and the first ``end`` event per transaction and home.

    ``from_machine`` and ``to_machine`` are the smallest machine ids that logged the event, not
    those of the first event. Only transactions coordinated in ``region``.
    """
    keys = run_keys(events, txns) + ["txn_id"] if keys is None else as_list(keys)
    hops = _pair(
        events,
        [*keys, "home"],
        start,
        end,
        {
            "from_time": (F.min, start, "time"),
            "to_time": (F.min, end, "time"),
            "from_machine": (F.min, start, "machine"),
            "to_machine": (F.min, end, "machine"),
        },
    ).withColumn("diff", (F.col("to_time") - F.col("from_time")) / 1000000)
    facts = txn_facts(txns, keys).where(F.col("coordinator_region") == region)
    return hops.join(facts, keys)


def event_states(events, names=None, keys=None):
    """One row per transaction and machine: ``states``, a map of event to its first and last time.

    From it any number of pairs comes without another shuffle (``pairs_of``). States of parts of a
    log can be added up by ``merged_states``. With ``names`` only these events are kept, in one
    scan and one shuffle; without, all kinds of events are, of which a transaction has few, and the
    times are combined per event first.
    """
    keys = run_keys(events) + ["txn_id", "machine"] if keys is None else as_list(keys)
    known = events.dropna(subset=[*keys, "event", "time"])
    if names is None:
        found = known.groupBy(*keys, "event").agg(
            F.struct(F.min("time").alias("first"), F.max("time").alias("last")).alias("_span")
        )
        entry = F.struct(F.col("event").alias("key"), F.col("_span").alias("value"))
        return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("states"))
    names = list(dict.fromkeys(names))
    spans = []
    for i, name in enumerate(names):
        time = F.when(F.col("event") == name, F.col("time"))
        spans += [F.min(time).alias(f"_first_{i}"), F.max(time).alias(f"_last_{i}")]
    found = known.where(F.col("event").isin(names)).groupBy(*keys).agg(*spans)
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("key"),
                F.struct(
                    F.col(f"_first_{i}").alias("first"), F.col(f"_last_{i}").alias("last")
                ).alias("value"),
            )
            for i, name in enumerate(names)
        ]
    )
    seen = F.filter(entries, lambda x: x["value"]["last"].isNotNull())
    return found.select(*keys, F.map_from_entries(seen).alias("states"))


def merged_states(states, keys=None):
    """States of the same ``keys`` (fewer than before, or those of several parts) as one."""
    keys = run_keys(states) + ["txn_id", "machine"] if keys is None else as_list(keys)
    each = states.select(*keys, F.explode("states").alias("event", "_span"))
    spans = F.struct(F.min("_span.first").alias("first"), F.max("_span.last").alias("last"))
    found = each.groupBy(*keys, "event").agg(spans.alias("_span"))
    entry = F.struct(F.col("event").alias("key"), F.col("_span").alias("value"))
    return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("states"))


def _named_pairs(pairs):
    """{name: (start, end)}; pairs given as a list are named ``start_to_end``."""
    if isinstance(pairs, dict):
        return {name: tuple(pair) for name, pair in pairs.items()}
    return {f"{start}_to_{end}": (start, end) for start, end in pairs}


def pairs_of(states, pairs, time="last", wide=False):
    """The time between each pair's events, from ``event_states``.

    ``pairs`` is a list of (start, end) or maps names to them; ``time`` says whether the ``first``
    or the ``last`` time of an event counts. One row per transaction and pair with both events
    (``pair``, ``from``, ``to``, ``diff`` in ms), or if ``wide`` one row per transaction with any
    and a column of ms per pair.
    """
    named = _named_pairs(pairs)
    rest = [c for c in states.columns if c != "states"]

    def at(event):
        return F.try_element_at("states", F.lit(event))[time]

    return _pair_rows(states, rest, named, at, wide)


def _pair_rows(rows, rest, named, at, wide):
    """The pairs of each row; ``at`` gives the column with the time of an event."""
    if wide:
        columns = {n: (at(end) - at(start)) / 1000000 for n, (start, end) in named.items()}
        return rows.select(*rest, *[c.alias(n) for n, c in columns.items()]).dropna(
            how="all", subset=list(columns)
        )
    each = F.array(
        *[
            F.struct(F.lit(n).alias("pair"), at(start).alias("from"), at(end).alias("to"))
            for n, (start, end) in named.items()
        ]
    )
    found = rows.select(*rest, F.explode(each).alias("_pair")).select(*rest, "_pair.*")
    found = found.where(F.col("from").isNotNull() & F.col("to").isNotNull())
    return found.withColumn("diff", (F.col("to") - F.col("from")) / 1000000)


def event_pairs(events, pairs, txns=None, by=("machine",), time="last", wide=False, keys=None):
    """E1, E2, E3 for any number of pairs of events at once: one scan and one shuffle of the log.

    ``by`` are the columns besides the transaction that an event is told apart by (``home``,
    ``machine``, or ``region`` and ``partition`` of server events). With ``txns`` the facts of the
    transactions are joined, as in ``event_diff``.
    """
    keys = run_keys(*[t for t in (events, txns) if t is not None]) + ["txn_id"] if keys is None else as_list(keys)
    if time not in ("first", "last"):
        raise ValueError("time must be 'first' or 'last'")
    named, rest = _named_pairs(pairs), [*keys, *as_list(by)]
    # One column per event; maps of all times, as ``event_states`` makes them, cost several times more.
    names = list(dict.fromkeys(event for pair in named.values() for event in pair))
    columns = {name: f"_at_{i}" for i, name in enumerate(names)}
    how = F.min if time == "first" else F.max
    known = events.dropna(subset=[*rest, "event", "time"]).where(F.col("event").isin(names))
    times = known.groupBy(*rest).agg(
        *[how(F.when(F.col("event") == name, F.col("time"))).alias(c) for name, c in columns.items()]
    )
    found = _pair_rows(times, rest, named, lambda event: F.col(columns[event]), wide)
    return found if txns is None else found.join(txn_facts(txns, keys), keys)


def slow_events(diffs, ms, diff="diff"):
    """E5: the pairs that took longer than ``ms``."""
    return diffs.where(F.col(diff) > ms)


def region_counts(diffs, region="coordinator_region"):
    """Rows with a value per region, for every column."""
    rest = [c for c in diffs.columns if c != region]
    return diffs.groupBy(region).agg(*[F.count(c).alias(c) for c in rest])


def diff_series(diffs, region, home=None, time="from", keys=None):
    """The points (time, diff) of one region [and home] in time order.

    Times start at 0, the earliest time of the experiment (or of ``keys``) over all regions. That
    time is an aggregate, attached to the rows of the region; no breakdown is stored.
    """
    keys = run_keys(diffs) if keys is None else as_list(keys)
    starts = diffs.groupBy(*keys).agg(F.min(time).alias("_start"))
    rows = diffs.where(F.col("coordinator_region") == region)
    if home is not None:
        rows = rows.where(F.col("home") == home)
    shifted = attach(rows.select(*keys, "home", time, "diff"), starts, keys)
    shifted = shifted.withColumn(time, F.col(time) - F.col("_start")).drop("_start")
    return shifted.orderBy(*keys, time)
