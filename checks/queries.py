"""One query per operator over the log-shaped views, each with the SQL that must agree with it."""

import uuid

from pyspark.sql import functions as F

from checks.log_tree import write_tree
from checks.views import view, with_views
from runlens.functions.columns import coordinator_region, other_region
from runlens.functions.paths import config_label, tag_from_name
from runlens.operators import (
    clocks,
    deadlocks,
    events,
    frames,
    latency,
    reports,
    sampling,
    stats,
    throughput,
    window,
)
from runlens.operators.facts import with_metadata
from runlens.plans import studies
from runlens.plans.logs import RunLogs
from runlens.sources import archive_format, archives, corrupt, index, logs, store
from runlens.sources import reports as report_sources

QUERIES = {}
ORACLES = {}
EXACT = 1000000  # accuracy at which approximate percentiles of the check tables are exact


class Views:
    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name):
        return view(self.spark, self.sf_dir, name)


def check(name, sql):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def joined(col):
    """A list column as text, so that it compares the same everywhere."""
    column = F.col(col) if isinstance(col, str) else col
    return F.concat_ws(";", column.cast("array<string>"))


# The latencies and the per-machine rates that several oracles share.
LATENCY = "lat as (select *, (received_at - sent_at) / 1000000 as latency from txns)"
WINDOWED = """
w as (select *, min(sent_at) over (partition by prefix, machine) as lo,
             max(sent_at) over (partition by prefix, machine) as hi from txns),
smp as (select a.prefix, a.n, c.committed, a.n / c.committed * 100 as sample
        from (select prefix, count(sent_at) as n from txns group by prefix) a
        join (select prefix, cast(sum(committed) as bigint) as committed from summary group by prefix) c
        on a.prefix = c.prefix),
rates as (select w.prefix, w.machine,
                 count(*) * 1000000000 * (100 / any_value(sample)) / nullif(max(sent_at) - min(sent_at), 0)
                   as throughput
          from w join smp on w.prefix = smp.prefix
          where sent_at >= lo + 10000000000 and sent_at <= hi + 60000000000
          group by w.prefix, w.machine),
thr as (select prefix, sum(throughput) as throughput from rates group by prefix)"""
WINDOW = {"start_s": 10, "dur_s": 50}


# ---------------------------------------------------------------- throughput


@check(
    "throughput_by_experiment",
    f"""with {WINDOWED}
    select e.*, round(throughput, 6) as throughput
    from thr join experiments e on thr.prefix = e.prefix""",
)
def _(v):
    found = throughput.throughput_by_experiment(v.txns, v.summary, v.experiments, **WINDOW)
    return rounded(found, "throughput")


@check(
    "throughput_one_client_count",
    f"""with {WINDOWED}
    select e.*, round(throughput, 6) as throughput
    from thr join experiments e on thr.prefix = e.prefix where clients = 350""",
)
def _(v):
    found = throughput.throughput_by_experiment(
        v.txns, v.summary, v.experiments, clients=350, **WINDOW
    )
    return rounded(found, "throughput")


@check(
    "throughput_per_machine",
    f"with {WINDOWED} select prefix, machine, round(throughput, 6) as throughput from rates",
)
def _(v):
    found = throughput.throughput(v.txns, v.summary, per_machine=True, **WINDOW)
    return rounded(found, "throughput")


@check(
    "run_window",
    f"""with {WINDOWED}
    select prefix, machine, txn_id, sent_at from w where sent_at >= lo + 10000000000""",
)
def _(v):
    return window.run_window(v.txns, **WINDOW).select("prefix", "machine", "txn_id", "sent_at")


@check(
    "run_window_from_start",
    f"""with {WINDOWED}
    select prefix, machine, txn_id, sent_at from w
    where sent_at >= lo + 10000000000 and sent_at <= lo + 60000000000""",
)
def _(v):
    rows = window.run_window(v.txns, upper="from_start", **WINDOW)
    return rows.select("prefix", "machine", "txn_id", "sent_at")


@check(
    "committed_by_experiment",
    "select prefix, cast(sum(committed) as bigint) as committed from summary group by prefix",
)
def _(v):
    return throughput.committed(v.summary)


@check(
    "sample_rate",
    f"with {WINDOWED} select prefix, n as sent, committed, round(sample, 6) as sample from smp",
)
def _(v):
    return rounded(throughput.sample_rate(v.txns, v.summary), "sample")


@check(
    "counter_throughput",
    """select prefix, round(sum(committed / nullif(elapsed_time, 0) * 1000000000), 6) as throughput,
              cast(regexp_extract(prefix, 'sz([0-9]+)', 1) as int) as scale
       from summary group by prefix""",
)
def _(v):
    return rounded(throughput.counter_throughput(v.summary), "throughput")


@check(
    "throughput_over_time",
    f"""with {WINDOWED}
    select t.prefix, t.time, round(t.n * (100 / smp.sample), 6) as throughput
    from (select prefix, cast(floor(sent_at / 1000000000) as bigint) as time, count(*) as n
          from txns group by 1, 2) t join smp on t.prefix = smp.prefix""",
)
def _(v):
    return rounded(throughput.throughput_over_time(v.txns, v.summary), "throughput")


@check(
    "event_throughput",
    """select event, cast(floor(time / 1000000000) as bigint) as time, count(txn_id) * (100 / 20) as throughput
       from server_events group by 1, 2""",
)
def _(v):
    return throughput.event_throughput(v.server_events, sample=20)


@check(
    "event_throughput_machine",
    """select event, cast(floor(time / 1000000000) as bigint) as time, "partition", region,
              count(txn_id) * (100 / 20) as throughput
       from server_events group by 1, 2, 3, 4""",
)
def _(v):
    return throughput.event_throughput(v.server_events, sample=20, per_machine=True)


# ------------------------------------------------------------------- latency

_P = "quantile_disc(latency, 0.5) as p50, quantile_disc(latency, 0.99) as p99"
_P4 = """quantile_disc(latency, 0.5) as p50, quantile_disc(latency, 0.9) as p90,
         quantile_disc(latency, 0.95) as p95, quantile_disc(latency, 0.99) as p99"""
_FOUR = (0.5, 0.9, 0.95, 0.99)


@check(
    "latency",
    f"""with {LATENCY} select prefix, txn_id, coordinator, array_to_string(regions, ';') as regions,
        array_to_string(partitions, ';') as partitions, latency from lat""",
)
def _(v):
    rows = latency.latency(v.txns)
    return rows.withColumns({c: joined(c) for c in ("regions", "partitions")})


@check(
    "latency_sampled",
    f"""with {LATENCY} select prefix, txn_id, latency from lat
        where ('0x' || substr(md5(concat('0:', txn_id)), 1, 13))::bigint / 4503599627370496 < 0.2""",
)
def _(v):
    return latency.latency(v.txns, fraction=0.2, key="txn_id").select("prefix", "txn_id", "latency")


@check("latency_percentiles", f"with {LATENCY} select prefix, {_P4} from lat group by prefix")
def _(v):
    rows = latency.latency(v.txns)
    return latency.latency_percentiles(rows, probs=_FOUR, accuracy=EXACT)


@check(
    "latency_percentiles_exact",
    f"with {LATENCY} select coordinator >> 24 as region, {_P4} from lat group by 1",
)
def _(v):
    rows = latency.latency(v.txns).withColumn("region", F.shiftright("coordinator", 24))
    return latency.latency_percentiles(rows, "region", _FOUR, method="exact")


@check(
    "latency_percentiles_overall",
    f"with {LATENCY} select 'all' as of, {_P4} from lat",
)
def _(v):
    rows = latency.latency(v.txns)
    rows = rows.withColumn("of", F.lit("all"))  # one key with all rows
    return latency.latency_percentiles(rows, "of", _FOUR, method="exact")


@check(
    "latency_percentiles_single_home",
    f"""with {LATENCY} select e.*, p50, p99
        from (select prefix, {_P} from lat where len(regions) = 1 group by prefix) p
        join experiments e on p.prefix = e.prefix""",
)
def _(v):
    rows = latency.latency(v.txns)
    return latency.single_home_percentiles(rows, v.experiments, accuracy=EXACT)


@check(
    "latency_percentiles_stratified",
    f"""with {LATENCY},
        m as (select prefix, latency, txn_id,
                     count(*) over (partition by prefix, coordinator >> 24) as n
              from lat where len(regions) > 1)
        select e.*, p50, p99
        from (select prefix, {_P} from m
              where ('0x' || substr(md5(concat('1000:', txn_id)), 1, 13))::bigint / 4503599627370496
                    < least(1, 20 / n)
              group by prefix) p
        join experiments e on p.prefix = e.prefix""",
)
def _(v):
    rows = latency.latency(v.txns)
    return latency.stratified_percentiles(
        rows, v.experiments, n=20, key="txn_id", accuracy=EXACT
    )


@check(
    "latency_name_filter",
    f"with {LATENCY} select prefix, {_P} from lat where contains(prefix, 'sz7') group by prefix",
)
def _(v):
    rows = latency.latency(latency.named(v.txns, "sz7"))
    return latency.latency_percentiles(rows, accuracy=EXACT)


_REGIONAL = """reg as (select lat.txn_id, lat.latency, lat.regions, e.*,
    cast(case e.config_name when 'f.conf' then coordinator >> 24 when 'o.conf' then coordinator >> 16
         else floor(coordinator / 4) end as int) as coordinator_region
    from lat join experiments e on lat.prefix = e.prefix)"""
_SHIFTS = {"f.conf": 24, "o.conf": 16}


@check(
    "latency_by_region",
    f"""with {LATENCY}, {_REGIONAL}
    select prefix, txn_id, config_name, clients, coordinator_region, latency from reg
    where clients >= 350""",
)
def _(v):
    rows = latency.latency(v.txns)
    found = latency.latency_by_region(rows, v.experiments, _SHIFTS, F.col("clients") >= 350)
    return found.select(
        "prefix", "txn_id", "config_name", "clients", "coordinator_region", "latency"
    )


@check(
    "throughput_latency_curve",
    f"""with {WINDOWED}, {LATENCY}, {_REGIONAL}
    select e.config_name, e.clients, round(thr.throughput, 6) as throughput, p50, p90, p95, p99
    from thr join experiments e on thr.prefix = e.prefix
    join (select config_name, clients, {_P4} from reg group by 1, 2) p
    on p.config_name = e.config_name and p.clients = e.clients""",
)
def _(v):
    thr = throughput.throughput_by_experiment(v.txns, v.summary, v.experiments, **WINDOW)
    lat = latency.latency_by_region(latency.latency(v.txns), v.experiments, _SHIFTS)
    curve = latency.throughput_latency_curve(thr, lat, accuracy=EXACT)
    return rounded(curve, "throughput")


@check(
    "other_region",
    """select txn_id, coordinator >> 24 as coordinator_region,
              list_filter(regions, lambda x: x <> (coordinator >> 24))[1] as other_region from txns""",
)
def _(v):
    rows = v.txns.withColumn("coordinator_region", F.shiftright("coordinator", 24))
    return other_region(rows).select("txn_id", "coordinator_region", "other_region")


# ------------------------------------------------------------------- reports

_MIX = """mix as (select wl_mh, wl_hot, type, n as count,
                  100 * n / sum(n) over (partition by wl_mh, wl_hot) as pct
  from (select wl_mh, wl_hot, replace(type, 'too-old', 'other') as type, cast(sum(count) as bigint) as n
        from report group by 1, 2, 3))"""


@check(
    "report_throughput",
    "select wl_mh, wl_hot, round(sum(throughput), 4) as throughput from report group by 1, 2",
)
def _(v):
    return rounded(reports.report_throughput(v.report), "throughput", digits=4)


@check(
    "report_throughput_writes",
    """select wl_mh, wl_hot, round(sum(throughput), 4) as other_system from report
       where type = 'write' group by 1, 2""",
)
def _(v):
    found = reports.report_throughput(v.report, "other_system", ["write"])
    return rounded(found, "other_system", digits=4)


@check(
    "report_latency",
    """select wl_mh, wl_hot, round(avg(p50), 6) as p50, round(avg(p95), 6) as p95,
              round(avg(p99), 6) as p99, 'other' as config_name from report group by 1, 2""",
)
def _(v):
    return rounded(reports.report_latency(v.report, "other"), "p50", "p95", "p99")


@check("outcome_mix", f"with {_MIX} select wl_mh, wl_hot, type, count, round(pct, 6) as pct from mix")
def _(v):
    return rounded(reports.outcome_mix(v.report), "pct")


@check(
    "outcome_counts_wide",
    f"""with {_MIX}, p as (select wl_mh, wl_hot, max(count) filter (where type = 'write') as "write",
        max(count) filter (where type = 'deadlock') as deadlock,
        max(count) filter (where type = 'other') as other from mix group by 1, 2)
    select *, "write" + deadlock + other as "sum" from p""",
)
def _(v):
    return reports.outcome_counts_wide(reports.outcome_mix(v.report))


@check(
    "outcome_pct_wide",
    f"""with {_MIX} select wl_mh, wl_hot, round(max(pct) filter (where type = 'write'), 6) as "write",
        round(max(pct) filter (where type = 'deadlock'), 6) as deadlock,
        round(max(pct) filter (where type = 'other'), 6) as other from mix group by 1, 2""",
)
def _(v):
    found = reports.outcome_pct_wide(reports.outcome_mix(v.report))
    return rounded(found, "write", "deadlock", "other")


_MH = [0, 50, 100]
_PCT_COLS = ",\n".join(
    f"round(max(pct) filter (where type = '{t}' and wl_mh = {mh}), 6) as {t}_{mh}"
    for t in reports.OUTCOMES
    for mh in _MH
)


@check("outcome_pct_two_keys", f"with {_MIX} select 1 / wl_hot as hot, {_PCT_COLS} from mix group by wl_hot")
def _(v):
    found = reports.outcome_pct_wide(reports.outcome_mix(v.report), mh_values=_MH)
    return rounded(found, *[c for c in found.columns if c != "hot"])


# Rows of a first system with the workload settings of the report.
_OURS = """ours as (select wl_mh, wl_hot, concat(lower(type), '.conf') as config_name,
                    sum(throughput) / 2 as throughput from report group by 1, 2, 3)"""
_THEIRS = "theirs as (select wl_mh, wl_hot, sum(throughput) as crossref from report group by 1, 2)"
_CONFIGS = ["write.conf", "deadlock.conf"]


def _ours(v):
    by = ["wl_mh", "wl_hot", F.concat(F.lower("type"), F.lit(".conf")).alias("config_name")]
    return v.report.groupBy(*by).agg((F.sum("throughput") / 2).alias("throughput"))


def _theirs(v):
    return reports.report_throughput(v.report, "crossref")


@check(
    "compare_systems",
    f"""with {_OURS}, {_THEIRS}
    select p.*, round(t.crossref, 4) as crossref from
      (select wl_mh, wl_hot,
              round(max(throughput) filter (where config_name = 'write.conf'), 4) as "write.conf",
              round(max(throughput) filter (where config_name = 'deadlock.conf'), 4) as "deadlock.conf"
       from ours group by 1, 2) p
    left join theirs t on p.wl_mh = t.wl_mh and p.wl_hot = t.wl_hot""",
)
def _(v):
    found = reports.compare_systems(_ours(v), _theirs(v), _CONFIGS)
    return found.select(
        "wl_mh",
        "wl_hot",
        *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in [*_CONFIGS, "crossref"]],
    )


@check(
    "compare_systems_aggregated",
    f"""with o as (select wl_mh, wl_hot, concat(lower(type), '.conf') as config_name, throughput from report),
    {_THEIRS}
    select p.*, round(t.crossref, 4) as crossref from
      (select wl_mh, wl_hot,
              round(avg(throughput) filter (where config_name = 'write.conf'), 4) as "write.conf",
              round(avg(throughput) filter (where config_name = 'deadlock.conf'), 4) as "deadlock.conf"
       from o group by 1, 2) p
    left join theirs t on p.wl_mh = t.wl_mh and p.wl_hot = t.wl_hot""",
)
def _(v):
    name = F.concat(F.lower("type"), F.lit(".conf")).alias("config_name")
    ours = v.report.select("wl_mh", "wl_hot", name, "throughput")
    found = reports.compare_systems(ours, _theirs(v), _CONFIGS, agg=F.avg)
    return found.select(
        "wl_mh",
        "wl_hot",
        *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in [*_CONFIGS, "crossref"]],
    )


@check(
    "relative_to_base",
    f"""with {_THEIRS}
    select t.wl_mh, t.wl_hot, round(t.crossref / b.crossref, 8) as crossref
    from theirs t left join (select * from theirs where wl_hot = 1000000) b on t.wl_mh = b.wl_mh""",
)
def _(v):
    found = reports.relative_to(_theirs(v), "wl_mh", F.col("wl_hot") == 1000000, "crossref")
    return rounded(found, "crossref", digits=8)


@check(
    "scale_by_max_wide",
    f"""with {_THEIRS}, s as (select wl_mh, 1 / wl_hot as hot,
                                     round(crossref / (select max(crossref) from theirs), 8) as share from theirs)
    select hot, max(share) filter (where wl_mh = 0) as crossref_0,
           max(share) filter (where wl_mh = 50) as crossref_50,
           max(share) filter (where wl_mh = 100) as crossref_100 from s group by hot""",
)
def _(v):
    found = reports.scale_by_max_wide(_theirs(v), "crossref", _MH)
    return rounded(found, "crossref_0", "crossref_50", "crossref_100", digits=8)


@check(
    "stack_systems",
    f"""with {_OURS}
    select wl_mh, 1 / wl_hot as wl_hot, config_name, round(throughput, 4) as throughput,
           cast(null as double) as p99 from ours
    union all
    select wl_mh, 1 / wl_hot, 'other', null, round(avg(p99), 6) from report group by wl_mh, report.wl_hot""",
)
def _(v):
    theirs = reports.report_latency(v.report, "other", ["p99"])
    stacked = reports.stack_systems(_ours(v), theirs)
    return rounded(rounded(stacked, "throughput", digits=4), "p99")


# ------------------------------------------------- clocks, deadlocks, graphs


@check(
    "clock_deviation",
    """select region, "partition", count(*) as n, round(avg(dev), 6) as mean_dev, min(dev) as min_dev,
              max(dev) as max_dev
       from (select *, (txn_timestamp - server_time) / 1000000 as dev from timestamps) group by 1, 2""",
)
def _(v):
    return rounded(clocks.clock_deviation(clocks.with_deviation(v.timestamps)), "mean_dev")


def _box_sql(source, keys):
    return f"""
    v as (select {keys}, x from {source}),
    q as (select {keys}, count(*) as n, min(x) as low, max(x) as high, quantile_cont(x, 0.25) as q1,
                 quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3 from v group by {keys}),
    box as (select {keys}, any_value(n) as n, any_value(low) as low, any_value(high) as high,
                   round(any_value(q1), 6) as q1, round(any_value(median), 6) as median,
                   round(any_value(q3), 6) as q3,
                   least(min(x) filter (where x >= q1 - 1.5 * (q3 - q1)), any_value(q1)) as whisker_low,
                   greatest(max(x) filter (where x <= q3 + 1.5 * (q3 - q1)), any_value(q3)) as whisker_high,
                   count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) as outliers
            from v join q using ({keys}) group by {keys})"""


_BOX_COLS = "cast(low as int) as low, cast(high as int) as high, q1, median, q3, whisker_low, whisker_high"


@check(
    "deadlock_profile",
    f"""with d as (select config_name, wl_mh, vertices as x from deadlocks
                   where region = 0 and wl_mh >= 20 and config_name in ('af.conf', 'rf.conf')),
    {_box_sql("d", "config_name, wl_mh")}
    select box.config_name, box.wl_mh, cast(c.committed as bigint) as committed, box.n as deadlocks,
           {_BOX_COLS}, outliers
    from box join (select config_name, wl_mh, sum(committed) as committed
                   from deadlock_summary s join deadlock_experiments e on s.prefix = e.prefix group by 1, 2) c
    on box.config_name = c.config_name and box.wl_mh = c.wl_mh""",
)
def _(v):
    chosen = (F.col("wl_mh") >= 20) & F.col("config_name").isin("af.conf", "rf.conf")
    found = deadlocks.deadlock_profile(
        v.deadlocks, v.deadlock_experiments, v.deadlock_summary, chosen
    )
    return rounded(found, "q1", "median", "q3", "whisker_low", "whisker_high")


@check(
    "deadlock_totals",
    """select e.prefix, count(d.prefix) as deadlock_cnt, cast(sum(vertices) as bigint) as deadlock_sz
       from deadlock_experiments e
       left join (select * from deadlocks where region = 0) d on e.prefix = d.prefix
       group by e.prefix""",
)
def _(v):
    return deadlocks.deadlock_totals(v.deadlocks, v.deadlock_experiments)


@check(
    "graph_size_series",
    """select time, "partition", region, runtime, round(unstable_graph_sz / 1000 - stable_graph_sz / 1000, 6)
              as unstable_graph_sz, stable_graph_sz / 1000 as stable_graph_sz, deadlocks_resolved,
              graph_update_time
       from resolver where time >= 820454400000000000 and time < 852076800000000000""",
)
def _(v):
    found = deadlocks.graph_size_series(v.resolver, 820454400000000000, 852076800000000000)
    return rounded(found, "unstable_graph_sz")


# -------------------------------------------------------------------- events


def _pair_sql(source, keys, how="max"):
    return f"""select {keys}, {how}(time) filter (where event = 'click') as "from",
           {how}(time) filter (where event = 'purchase') as "to"
    from {source} group by {keys}"""


_FACTS = """f as (select txn_id, coordinator, array_to_string(regions, ';') as regions,
    array_to_string(partitions, ';') as partitions, prefix, len(regions) as num_regions,
    len(partitions) as num_partitions, machine as coordinator_region from txns)"""


def _with_text(df):
    return df.withColumns({c: joined(c) for c in ("regions", "partitions")}).withColumns(
        {c: F.col(c).cast("long") for c in ("num_regions", "num_partitions")}
    )


@check(
    "events_latency",
    f"""select txn_id, machine, ("to" - "from") / 1000000 as click_to_purchase
        from ({_pair_sql("client_events", "txn_id, machine")})
        where "from" is not null and "to" is not null""",
)
def _(v):
    return events.events_latency(v.client_events, "click", "purchase")


@check(
    "event_diff",
    f"""with {_FACTS}, p as ({_pair_sql("client_events", "txn_id, machine")})
    select p.machine, p."from", p."to", ("to" - "from") / 1000000 as diff, f.*
    from p join f on p.txn_id = f.txn_id where "from" is not null and "to" is not null""",
)
def _(v):
    return _with_text(events.event_diff(v.client_events, v.txns, "click", "purchase"))


@check(
    "event_diff_home",
    f"""with {_FACTS}, p as ({_pair_sql("client_events", "txn_id, home")})
    select p.home, p."from", p."to", ("to" - "from") / 1000000 as diff, f.*
    from p join f on p.txn_id = f.txn_id where "from" is not null and "to" is not null""",
)
def _(v):
    return _with_text(
        events.event_diff(
            v.client_events, v.txns, "click", "purchase", by_home=True, by_machine=False
        )
    )


@check(
    "event_diff_server",
    f"""select *, ("to" - "from") / 1000000 as diff
        from ({_pair_sql("(select txn_id // 16 as txn_id, event, time, \"partition\" from server_events)", 'txn_id, "partition"')})
        where "from" is not null and "to" is not null""",
)
def _(v):
    # Sixteen events in a row are those of a transaction.
    rows = v.server_events.withColumn("txn_id", F.floor(F.col("txn_id") / 16))
    return events.event_diff_server(rows, "click", "purchase")


@check(
    "event_diff_server_region",
    f"""select *, ("to" - "from") / 1000000 as diff
        from ({_pair_sql("(select txn_id // 64 as txn_id, event, time, region from server_events)", "txn_id, region")})
        where "from" is not null and "to" is not null""",
)
def _(v):
    rows = v.server_events.withColumn("txn_id", F.floor(F.col("txn_id") / 64))
    return events.event_diff_server(rows, "click", "purchase", by_region=True, by_partition=False)


_PAIRS = [("click", "purchase"), ("view", "click"), ("purchase", "view"), ("signup", "click")]


def _pairs_sql(source, keys, rest="", pairs=_PAIRS, how="max"):
    """One row per keys and pair, each pair from a query of its own."""
    return " union all ".join(
        f"""select {keys}, '{a}_to_{b}' as pair, {how}(time) filter (where event = '{a}') as "from",
        {how}(time) filter (where event = '{b}') as "to", (("to") - ("from")) / 1000000 as diff{rest}
        from {source} group by {keys} having "from" is not null and "to" is not null"""
        for a, b in pairs
    )


@check("event_pairs", _pairs_sql("client_events", "txn_id, machine"))
def _(v):
    return events.event_pairs(v.client_events, _PAIRS)


@check("event_pairs_server", _pairs_sql("server_events", "txn_id, region, partition", how="min"))
def _(v):
    return events.event_pairs(v.server_events, _PAIRS, by=["region", "partition"], time="first")


@check(
    "event_pairs_wide",
    """select txn_id, machine, home, (max(time) filter (where event = 'purchase')
           - max(time) filter (where event = 'click')) / 1000000 as buying,
       (max(time) filter (where event = 'click') - max(time) filter (where event = 'view')) / 1000000 as looking
       from client_events group by txn_id, machine, home having buying is not null or looking is not null""",
)
def _(v):
    pairs = {"buying": ("click", "purchase"), "looking": ("view", "click")}
    return events.event_pairs(v.client_events, pairs, by=["machine", "home"], wide=True)


@check("event_pairs_merged", _pairs_sql("client_events", "txn_id"))
def _(v):
    """States of each machine and home, added up to those of the transaction."""
    states = store.settle(events.event_states(v.client_events, keys=["txn_id", "machine", "home"]))
    return events.pairs_of(events.merged_states(states, ["txn_id"]), _PAIRS)


@check(
    "event_pairs_with_transactions",
    f"""with {_FACTS}, p as ({_pairs_sql("client_events", "txn_id, home")})
    select p.*, coordinator, regions, partitions, num_regions, num_partitions, coordinator_region
    from p join f on p.txn_id = f.txn_id""",
)
def _(v):
    return _with_text(events.event_pairs(v.client_events, _PAIRS, v.txns.drop("prefix"), by=["home"]))


_HOME_DIFF = f"""{_FACTS}, p as ({_pair_sql("client_events", "txn_id, home")}),
    diffs as (select p.home, p."from", p."to", ("to" - "from") / 1000000 as diff, f.*
              from p join f on p.txn_id = f.txn_id where "from" is not null and "to" is not null)"""


def _home_diff(v):
    return events.event_diff(
        v.client_events, v.txns, "click", "purchase", by_home=True, by_machine=False
    )


@check(
    "hop_diff",
    f"""with {_FACTS}, p as (select txn_id, home, min(time) filter (where event = 'click') as from_time,
        min(time) filter (where event = 'purchase') as to_time,
        min(machine) filter (where event = 'click') as from_machine,
        min(machine) filter (where event = 'purchase') as to_machine from client_events group by 1, 2)
    select p.home, from_time, to_time, from_machine, to_machine,
           (to_time - from_time) / 1000000 as diff, f.*
    from p join f on p.txn_id = f.txn_id
    where from_time is not null and to_time is not null and coordinator_region = 3""",
)
def _(v):
    return _with_text(events.hop_diff(v.client_events, v.txns, "click", "purchase", 3))


@check(
    "slow_events",
    f"""with {_HOME_DIFF} select txn_id, home, diff from diffs where diff > 2000""",
)
def _(v):
    return events.slow_events(_home_diff(v), 2000).select("txn_id", "home", "diff")


@check(
    "region_counts",
    f"""with {_HOME_DIFF} select coordinator_region, count(txn_id) as txn_id, count(home) as home,
        count(diff) as diff from diffs group by 1""",
)
def _(v):
    rows = _home_diff(v).select("coordinator_region", "txn_id", "home", "diff")
    return events.region_counts(rows)


@check(
    "diff_series",
    f"""with {_HOME_DIFF} select home, "from" - (select min("from") from diffs) as "from", diff
        from diffs where coordinator_region = 3 and home = 1""",
)
def _(v):
    return events.diff_series(_home_diff(v), 3, 1, keys=())


@check(
    "gaps",
    """select region, txn_id, time, lead(time) over (partition by region order by time, txn_id) - time as gap
       from server_events
       qualify row_number() over (partition by region order by time, txn_id) > 1""",
)
def _(v):
    rows = v.server_events.select("region", "txn_id", "time")
    return stats.gaps(rows, "region", "time", "txn_id")


# ---------------------------------------------------------------- statistics


@check(
    "cdf",
    f"""with {LATENCY} select prefix, latency, row_number() over (partition by prefix order by latency)
        / count(*) over (partition by prefix) as y from lat""",
)
def _(v):
    return stats.cdf(latency.latency(v.txns), "prefix", "latency")


@check(
    "cdf_by_region",
    f"""with {LATENCY}, {_REGIONAL}
    select config_name, coordinator_region, multi_home, latency, txn_id,
           row_number() over (w order by latency, txn_id) / count(*) over w as y
    from (select *, len(regions) > 1 as multi_home from reg)
    window w as (partition by config_name, coordinator_region, multi_home)""",
)
def _(v):
    rows = latency.latency_by_region(latency.latency(v.txns), v.experiments, _SHIFTS)
    rows = rows.withColumn("multi_home", F.size("regions") > 1)
    return stats.cdf(
        rows, ["config_name", "coordinator_region", "multi_home"], "latency", "txn_id"
    )


@check(
    "shift_to_zero",
    """select region, txn_id, time - min(time) over (partition by region) as time from server_events""",
)
def _(v):
    return stats.shift_to_zero(v.server_events.select("region", "txn_id", "time"), "region", "time")


@check(
    "min_max_scale",
    """select region, txn_id, (time - min(time) over w) / nullif(max(time) over w - min(time) over w, 0) as time
       from server_events window w as (partition by region)""",
)
def _(v):
    return stats.min_max_scale(v.server_events.select("region", "txn_id", "time"), "region", "time")


@check(
    "drop_constant_columns",
    "select prefix, time, vertices, 'kept' as note from deadlocks",
)
def _(v):
    rows = v.deadlocks.select("prefix", F.lit(100).alias("wl_mp"), "time", "vertices")
    rows = rows.withColumn("empty", F.lit(None).cast("int"))
    return stats.drop_constant_columns(rows.withColumn("note", F.lit("kept")), ignore=["note"])


@check(
    "box_stats",
    f"""with d as (select config_name, vertices as x from deadlocks), {_box_sql("d", "config_name")}
    select config_name, n, {_BOX_COLS}, outliers from box""",
)
def _(v):
    found = stats.box_stats(v.deadlocks, "config_name", "vertices")
    return rounded(found, "q1", "median", "q3", "whisker_low", "whisker_high")


@check(
    "sample_rows",
    """select o_orderkey from orders
       where ('0x' || substr(md5(concat('0:', o_orderkey)), 1, 13))::bigint / 4503599627370496 < 0.1""",
)
def _(v):
    return sampling.sample_rows(v.orders, 0.1, "o_orderkey").select("o_orderkey")


@check(
    "stratified_sample",
    """select o_orderpriority, o_orderkey from (select o_orderpriority, o_orderkey,
              count(*) over (partition by o_orderpriority) as n from orders)
       where ('0x' || substr(md5(concat('1000:', o_orderkey)), 1, 13))::bigint / 4503599627370496
             < least(1, 200 / n)""",
)
def _(v):
    rows = v.orders.select("o_orderpriority", "o_orderkey")
    return sampling.stratified_sample(rows, "o_orderpriority", 200, "o_orderkey")


@check(
    "stratified_sample_fixed",
    """select o_orderpriority, o_orderkey from (select o_orderpriority, o_orderkey,
              row_number() over (partition by o_orderpriority
                  order by ('0x' || substr(md5(concat('1000:', o_orderkey)), 1, 13))::bigint) as k
              from orders) where k <= 200""",
)
def _(v):
    rows = v.orders.select("o_orderpriority", "o_orderkey")
    return sampling.fixed_sample(rows, "o_orderpriority", 200, "o_orderkey")


# -------------------------------------------------------------------- frames


@check(
    "series",
    f"""with {WINDOWED} select e.prefix, config_name, wl_mh, round(throughput / 1000, 8) as throughput
        from thr join experiments e on thr.prefix = e.prefix
        where wl_hot = 1000 and starts_with(config_name, 'f')""",
)
def _(v):
    thr = throughput.throughput_by_experiment(v.txns, v.summary, v.experiments, **WINDOW)
    found = frames.series(
        thr, F.col("wl_hot") == 1000, "wl_mh", "throughput", 1000, config_prefix="f"
    )
    return rounded(found, "throughput", digits=8).select(
        "prefix", "config_name", "wl_mh", "throughput"
    )


_WIDE = """round(max(throughput) filter (where config_name = 'f.conf'), 6) as "First",
           round(max(throughput) filter (where config_name = 'o.conf'), 6) as "Second",
           round(max(throughput) filter (where config_name = 'p.conf'), 6) as "Third\""""


@check(
    "throughput_wide",
    f"""with {WINDOWED}, t as (select e.*, throughput from thr join experiments e on thr.prefix = e.prefix)
    select clients, wl_mh, {_WIDE} from t group by clients, wl_mh""",
)
def _(v):
    thr = throughput.throughput_by_experiment(v.txns, v.summary, v.experiments, **WINDOW)
    labels = {"f.conf": "First", "o.conf": "Second", "p.conf": "Third"}
    found = frames.throughput_wide(thr, list(labels), ["clients", "wl_mh"], labels=labels)
    return rounded(found, *labels.values())


@check(
    "throughput_wide_all",
    f"""with {WINDOWED}, t as (select e.*, throughput from thr join experiments e on thr.prefix = e.prefix)
    select clients, {_WIDE} from t group by clients""",
)
def _(v):
    thr = throughput.throughput_by_experiment(v.txns, v.summary, v.experiments, **WINDOW)
    labels = {"f.conf": "First", "o.conf": "Second", "p.conf": "Third"}
    found = frames.throughput_wide(thr, list(labels), labels=labels, agg=F.max)
    return rounded(found, *labels.values())


@check("axis_values", "select distinct wl_hot from experiments")
def _(v):
    return frames.axis_values(v.experiments, "wl_hot", desc=True)


@check(
    "config_label",
    """select prefix, case config_name when 'f.conf' then 'Finished' else replace(config_name, '.conf', '')
              end as config_name,
              cast(nullif(regexp_extract(prefix, 'sz([0-9]+)', 1), '') as int) as scale,
              cast(null as int) as jitter from experiments""",
)
def _(v):
    labelled = config_label(v.experiments, {"f.conf": "Finished"})
    tagged = tag_from_name(labelled, "scale", r"sz(\d+)")
    return tag_from_name(tagged, "jitter", r"jitter(\d+)").select(
        "prefix", "config_name", "scale", "jitter"
    )


@check(
    "coordinator_region",
    f"""with {LATENCY}, {_REGIONAL} select txn_id, config_name, coordinator_region from reg""",
)
def _(v):
    rows = with_metadata(v.txns, v.experiments.select("prefix", "config_name"))
    return coordinator_region(rows, _SHIFTS).select("txn_id", "config_name", "coordinator_region")


@check(
    "coordinator_region_plain",
    f"""with {LATENCY}, {_REGIONAL}
    select txn_id, replace(config_name, '.conf', '') as config_name, coordinator_region from reg""",
)
def _(v):
    rows = with_metadata(v.txns, config_label(v.experiments.select("prefix", "config_name")))
    return coordinator_region(rows, _SHIFTS).select("txn_id", "config_name", "coordinator_region")


# ------------------------------------------------------------------- sources
# Each check writes a view as a tree of logs in the shared folder and reads it back.


def _experiment(df):
    """Readers give the full path of an experiment; the views know its name."""
    return df.withColumn("experiment", F.element_at(F.split("prefix", "/"), -1)).drop("prefix")


def _txn_logs(v):
    return v.txns.select(
        F.concat(F.lit("exp-"), F.col("coordinator") % 4).alias("_experiment"),
        F.col("machine").alias("_directory"),
        "txn_id",
        "coordinator",
        joined(F.reverse("regions")).alias("regions"),  # the reader sorts them
        joined(F.reverse("partitions")).alias("partitions"),
        (F.col("txn_id") * 3 + 1).alias("generator"),
        (F.col("txn_id") % 5).alias("restarts"),
        F.concat_ws(";", F.col("txn_id") % 7, F.col("txn_id") % 3).alias("global_log_pos"),
        "sent_at",
        "received_at",
    )


_TXN_COLS = [
    "txn_id", "coordinator", "regions", "partitions", "generator", "restarts", "global_log_pos",
    "sent_at", "received_at",
]
_TXN_SQL = """select concat('exp-', coordinator % 4) as experiment, machine, txn_id, coordinator,
    array_to_string(regions, ';') as regions, array_to_string(partitions, ';') as partitions,
    txn_id * 3 + 1 as generator, cast(txn_id % 5 as int) as restarts,
    concat(txn_id % 7, ';', txn_id % 3) as global_log_pos,
    sent_at, received_at from txns"""


def _txn_text(df):
    lists = ("regions", "partitions", "global_log_pos")
    return _experiment(df).withColumns({c: joined(c) for c in lists})


@check("read_log_tree_transactions", _TXN_SQL)
def _(v):
    root = write_tree(_txn_logs(v), "client", "transactions.csv", _TXN_COLS)
    return _txn_text(logs.read_transactions(v.spark, root))


@check(
    "read_corrupt_lines",
    """with l as (select concat('exp-', coordinator % 4) as experiment, machine, txn_id from txns),
    f as (select experiment, machine, 'sent_at: no double' as reason from l where txn_id % 7 = 1
          union all select experiment, machine, 'regions: no number in the list' from l where txn_id % 5 = 2
          union all select experiment, machine, 'restarts: no int' from l where txn_id % 11 = 3)
    select 'transactions' as log, experiment, machine, reason, count(*) as n from f group by all""",
)
def _(v):
    """Counts of the lines with malformed fields, per file, added up per machine."""

    def spoiled(name, by, rest, text):
        return F.when(F.col("txn_id") % by == rest, F.lit(text)).otherwise(F.col(name).cast("string"))

    rows = _txn_logs(v).withColumns(
        {
            "sent_at": spoiled("sent_at", 7, 1, "late"),
            "regions": spoiled("regions", 5, 2, "1;x;2"),
            "restarts": spoiled("restarts", 11, 3, "none"),
        }
    )
    root = write_tree(rows, "client", "transactions.csv", _TXN_COLS)
    found = corrupt.corrupt_counts(v.spark, root)
    machine = F.regexp_extract("file", "/client/([0-9]+)/", 1).cast("int").alias("machine")
    counted = found.groupBy("log", "prefix", machine, "reason").agg(F.sum("n").alias("n"))
    return _experiment(counted)


@check("read_refreshed_store", _TXN_SQL)
def _(v):
    """A store that is filled, then follows an experiment that comes later."""
    rows, late = _txn_logs(v), F.col("_experiment") == "exp-3"
    store_path = f"{store.scratch_dir(v.spark)}/store-{uuid.uuid4().hex}"
    root = write_tree(rows.where(~late), "client", "transactions.csv", _TXN_COLS)
    RunLogs(v.spark, root, store=store_path).transactions
    write_tree(rows.where(late), "client", "transactions.csv", _TXN_COLS, root=root)
    found = RunLogs(v.spark, root, store=store_path).transactions
    return _txn_text(found.select(*[c for c in found.columns if c != "prefix"], "prefix"))


@check("read_archives", _TXN_SQL)
def _(v):
    root = write_tree(_txn_logs(v), "client", "transactions.csv", _TXN_COLS, archives=True)
    found = archives.read_archived(v.spark, f"{root}/*/*.tar.gz", "transactions.csv")
    # An archive p0.tar.gz stands for a directory p0 of its experiment.
    named = found.withColumn("prefix", F.regexp_replace("prefix", "/p[0-9]+$", ""))
    return _txn_text(named)


@check("read_archives_format", _TXN_SQL)
def _(v):
    """Through the data source, with a filter that it takes into the archives."""
    root = write_tree(_txn_logs(v), "client", "transactions.csv", _TXN_COLS, archives=True)
    lines = archive_format.register_archives(v.spark).read.format(archive_format.NAME)
    lines = lines.load(f"{root}/*/*.tar.gz").where(F.col("member").contains("transactions.csv"))
    found = archives.archived_table(lines, "transactions.csv")
    named = found.withColumn("prefix", F.regexp_replace("prefix", "/p[0-9]+$", ""))
    return _txn_text(named)


@check(
    "read_log_tree_summary",
    """select concat('exp-', substr(prefix, 5, 1)) as experiment, machine, committed, aborted,
              committed + 1 as not_started, committed + 2 as restarted,
              committed + 3 as single_home, committed + 4 as multi_home,
              committed + 5 as single_partition, committed + 6 as multi_partition,
              committed + 7 as remaster, elapsed_time from summary""",
)
def _(v):
    cols = logs.schemas.names(logs.schemas.SUMMARY)
    rest = [c for c in cols if c not in v.summary.columns]
    rows = v.summary.select(
        F.concat(F.lit("exp-"), F.substring("prefix", 5, 1)).alias("_experiment"),
        F.col("machine").alias("_directory"),
        "committed",
        "aborted",
        "elapsed_time",
        *[(F.col("committed") + i).alias(c) for i, c in enumerate(rest, 1)],
    )
    return _experiment(logs.read_summary(v.spark, write_tree(rows, "client", "summary.csv", cols)))


def _server_rows(df, cols):
    return df.select(
        F.lit("exp").alias("_experiment"),
        F.concat_ws("-", "region", "partition").alias("_directory"),
        *cols,
    )


@check(
    "read_log_tree_deadlocks",
    """select config_name as experiment, time, "partition", region as replica, vertices from deadlocks""",
)
def _(v):
    cols = ["time", "partition", "region", "vertices"]
    rows = _server_rows(v.deadlocks, ["config_name", *cols])
    rows = rows.withColumn("_experiment", F.col("config_name"))
    root = write_tree(rows, "server", "deadlocks.csv", cols)
    return _experiment(logs.read_deadlocks(v.spark, root, region_col="replica"))


@check(
    "read_log_tree_timestamps",
    """select 'exp' as experiment, txn_id, "from", txn_timestamp, server_time,
              (txn_timestamp - server_time) / 1000000 as dev, region, "partition" from timestamps""",
)
def _(v):
    cols = ["txn_id", "from", "txn_timestamp", "server_time"]
    root = write_tree(_server_rows(v.timestamps, cols), "server", "txn_timestamps.csv", cols)
    return _experiment(logs.read_txn_timestamps(v.spark, root))


@check(
    "read_log_tree_measurements",
    """select 'exp' as experiment, type, time, data, "partition", region from measurements""",
)
def _(v):
    cols = ["type", "time", "data", "partition", "region"]
    root = write_tree(_server_rows(v.measurements, cols), "server", "generic.csv", cols)
    return _experiment(logs.read_measurements(v.spark, root))


@check(
    "read_log_tree_measurements_legacy",
    """select 'exp' as experiment, cast(type as bigint) as type, time, data / 1000000 as data, "partition",
              region as replica from measurements where type = 2""",
)
def _(v):
    cols = ["type", "time", "data", "partition", "region"]
    rows = _server_rows(v.measurements, cols).withColumn("_directory", F.lit("0-0"))
    root = write_tree(rows, "server", "generic.csv", cols)
    return _experiment(logs.read_measurements(v.spark, root, legacy=True, kind=2))


@check(
    "read_log_tree_client_events",
    "select 'exp' as experiment, txn_id, event, time, machine, home from client_events",
)
def _(v):
    cols = ["txn_id", "event", "time", "machine", "home"]
    rows = v.client_events.select(
        F.lit("exp").alias("_experiment"), F.col("machine").alias("_directory"), *cols
    )
    root = write_tree(rows, "client", "txn_events.csv", cols)
    return _experiment(logs.read_client_events(v.spark, root))


@check(
    "read_log_tree_server_events",
    """select 'exp' as experiment, txn_id, event, time, "partition", region from server_events""",
)
def _(v):
    cols = ["txn_id", "event", "time", "partition", "region"]
    root = write_tree(_server_rows(v.server_events, cols), "server", "events.csv", cols)
    return _experiment(logs.read_server_events(v.spark, root))


@check(
    "read_log_tree_link_latency",
    "select 'exp' as experiment, src, dst, send_time, recv_time, avg_latency from link_latency",
)
def _(v):
    cols = ["dst", "send_time", "recv_time", "avg_latency"]
    rows = v.link_latency.select(
        F.lit("exp").alias("_experiment"), F.col("src").alias("_directory"), *cols
    )
    root = write_tree(rows, "server", "forw_sequ_latency.csv", cols)
    return _experiment(logs.read_link_latency(v.spark, root))


@check(
    "read_log_tree_resolver",
    """select 'exp' as experiment, time, "partition", region, runtime, unstable_graph_sz, stable_graph_sz,
              deadlocks_resolved, graph_update_time from resolver""",
)
def _(v):
    cols = logs.schemas.names(logs.schemas.RESOLVER)
    rows = _server_rows(v.resolver, cols).withColumn("_directory", F.lit("0-0"))
    return _experiment(logs.read_resolver(v.spark, write_tree(rows, "server", "deadlock_resolver.csv", cols)))


@check("read_log_tree_report", "select * from report")
def _(v):
    path = f"{store.scratch_dir(v.spark)}/report-{uuid.uuid4().hex}"
    v.report.write.option("header", True).csv(path)
    return report_sources.read_report(v.spark, path)


@check(
    "read_log_tree_latency_report",
    """select wl_mh, wl_hot, region, throughput, avg, p50, p95, p99, "pMax" from report""",
)
def _(v):
    path = f"{store.scratch_dir(v.spark)}/report-{uuid.uuid4().hex}"
    v.report.drop("type", "count").write.option("header", True).csv(path)
    return report_sources.read_latency_report(v.spark, path)


@check(
    "read_log_tree_index",
    """select replace(prefix, '/', '-') as experiment, config_name, clients, wl_hot, wl_mh,
              clients + 1 as duration, wl_hot + 2 as txns, wl_mh + 3 as rate
       from experiments""",
)
def _(v):
    name = F.replace("prefix", F.lit("/"), F.lit("-")).alias("_experiment")
    two = F.col("machine") % 2
    server = v.base.select(
        name, F.concat(F.lit("0-"), two).alias("_directory"), "config_name"
    ).distinct()
    client = v.base.select(
        name,
        two.alias("_directory"),
        (F.col("clients") + 1).alias("duration"),
        (F.col("wl_hot") + 2).alias("txns"),
        "clients",
        (F.col("wl_mh") + 3).alias("rate"),
        F.col("wl_hot").alias("wl:hot"),
        F.col("wl_mh").alias("wl:mh"),
    ).distinct()
    root = write_tree(server, "server", "metadata.csv", ["config_name"])
    cols = ["duration", "txns", "clients", "rate", "wl:hot", "wl:mh"]
    # The machines of an experiment write the same columns in different orders.
    for machine, order in ((0, cols), (1, cols[::-1])):
        own = client.where(F.col("_directory") == machine)
        write_tree(own, "client", "metadata.csv", order, root=root)
    return _experiment(index.experiment_index(v.spark, root))


# ------------------------------------------------------------------- studies
# From a tree of logs to the result table. The tree has an experiment per order status.

_RUNS = """runs as (select concat('exp-', substr(prefix, 5, 1), '-sz5') as prefix, machine, txn_id,
    coordinator, regions, sent_at, received_at from txns),
counters as (select concat('exp-', substr(prefix, 5, 1), '-sz5') as prefix, machine,
    cast(sum(committed) as bigint) as committed, cast(sum(elapsed_time) as bigint) as elapsed_time
    from summary group by 1, 2)"""


def _study_logs(v, *files):
    """A tree with the named logs of the runs, and its metadata."""
    status = F.substring("prefix", 5, 1)
    name = F.concat(F.lit("exp-"), status, F.lit("-sz5")).alias("_experiment")
    machine = F.col("machine").alias("_directory")
    root = None
    if "transactions" in files:
        rows = v.txns.select(name, machine, *[
            joined(c).alias(c) if c in ("regions", "partitions")
            else F.col(c) if c in v.txns.columns else F.lit(0).alias(c)
            for c in _TXN_COLS
        ])
        root = write_tree(rows, "client", "transactions.csv", _TXN_COLS)
    if "summary" in files:
        cols = logs.schemas.names(logs.schemas.SUMMARY)
        sums = v.summary.groupBy(name, machine).agg(
            F.sum("committed").alias("committed"), F.sum("elapsed_time").alias("elapsed_time")
        )
        rows = sums.select("*", *[F.lit(0).alias(c) for c in cols if c not in sums.columns])
        root = write_tree(rows, "client", "summary.csv", cols, root=root)
    both = v.base.select(name, F.concat(status, F.lit(".conf")).alias("config_name")).distinct()
    both = store.settle(both, "runs")  # both sides of the metadata read it
    meta = {"duration": 60, "txns": 0, "clients": 100, "rate": 0}
    client = both.withColumns({c: F.lit(x) for c, x in meta.items()})
    write_tree(client.withColumn("_directory", F.lit(0)), "client", "metadata.csv", list(meta), root=root)
    server = both.withColumn("_directory", F.lit("0-0"))
    write_tree(server, "server", "metadata.csv", ["config_name"], root=root)
    return RunLogs(v.spark, root, plain_names=True)


_STUDY_INDEX = """round({0}, 6) as {0}, prefix as experiment, substr(prefix, 5, 1) as config_name,
    cast(60 as int) as duration, cast(0 as int) as txns, cast(100 as int) as clients, cast(0 as int) as rate"""


@check(
    "study_throughput",
    f"""with {_RUNS},
    w as (select *, min(sent_at) over (partition by prefix, machine) as lo from runs),
    rate as (select prefix, machine, count(*) as n, max(sent_at) - min(sent_at) as span
             from w where sent_at >= lo + 10000000000 group by 1, 2),
    smp as (select a.prefix, n / committed * 100 as sample
            from (select prefix, count(*) as n from runs group by 1) a
            join (select prefix, sum(committed) as committed from counters group by 1) c
            on a.prefix = c.prefix),
    t as (select rate.prefix, sum(rate.n * 1000000000 * (100 / smp.sample) / nullif(span, 0)) as throughput
          from rate join smp on rate.prefix = smp.prefix group by 1)
    select {_STUDY_INDEX.format("throughput")} from t""",
)
def _(v):
    run = _study_logs(v, "transactions", "summary")
    return _experiment(rounded(studies.throughput_study(run), "throughput"))


@check(
    "study_scalability",
    f"""with {_RUNS}, t as (select prefix, sum(committed / elapsed_time * 1000000000) as throughput
                            from counters group by 1)
    select {_STUDY_INDEX.format("throughput")}, cast(5 as int) as scale from t""",
)
def _(v):
    return _experiment(rounded(studies.scalability_study(_study_logs(v, "summary")), "throughput"))


@check(
    "study_latency_multi_home",
    f"""with {_RUNS},
    m as (select prefix, txn_id, (received_at - sent_at) / 1000000 as latency,
                 count(*) over (partition by prefix, coordinator >> 24) as n
          from runs where len(regions) > 1),
    t as (select prefix, quantile_disc(latency, 0.5) as p50, quantile_disc(latency, 0.99) as p99
          from m where ('0x' || substr(md5(concat('1000:', prefix, '|', txn_id)), 1, 13))::bigint / 4503599627370496
                       < least(1, 200 / n) group by prefix)
    select p99, {_STUDY_INDEX.format("p50")} from t""",
)
def _(v):
    run = _study_logs(v, "transactions")
    found = studies.latency_study(run, homes="multi", probs=(0.5, 0.99))
    return _experiment(rounded(found, "p50"))


@check(
    "study_latency_multi_home_fixed",
    f"""with {_RUNS},
    m as (select prefix, (received_at - sent_at) / 1000000 as latency,
                 row_number() over (partition by prefix, coordinator >> 24
                     order by ('0x' || substr(md5(concat('1000:', prefix, '|', txn_id)), 1, 13))::bigint) as k
          from runs where len(regions) > 1),
    t as (select prefix, quantile_disc(latency, 0.5) as p50, quantile_disc(latency, 0.99) as p99
          from m where k <= 200 group by prefix)
    select p99, {_STUDY_INDEX.format("p50")} from t""",
)
def _(v):
    run = _study_logs(v, "transactions")
    found = studies.latency_study(run, homes="multi", probs=(0.5, 0.99), fixed=True)
    return _experiment(rounded(found, "p50"))


_RUN_LAT = f"""{_RUNS}, lat as (select *, (received_at - sent_at) / 1000000 as latency,
    substr(prefix, 5, 1) as config_name,
    cast(case substr(prefix, 5, 1) when 'f' then coordinator >> 24 when 'o' then coordinator >> 16
         else floor(coordinator / 4) end as int) as coordinator_region from runs)"""


@check(
    "study_latency_exact",
    f"""with {_RUN_LAT}, t as (select prefix, {_P4} from lat group by prefix)
    select p90, p95, p99, {_STUDY_INDEX.format("p50")} from t""",
)
def _(v):
    found = studies.latency_study(_study_logs(v, "transactions"), method="exact")
    return _experiment(rounded(found, "p50"))


@check(
    "percentiles_from_stored_bins",
    f"""with {_RUN_LAT}
    select prefix as experiment, machine, cast(null as varchar) as config_name, {_P4} from lat group by 1, 2
    union all select prefix, null, null, {_P4} from lat group by 1
    union all select null, null, config_name, {_P4} from lat group by 3""",
)
def _(v):
    """Exact percentiles of three roll-ups from the counts of one store."""
    run = _study_logs(v, "transactions")
    run.store = f"{store.scratch_dir(v.spark)}/store-{uuid.uuid4().hex}"
    rows = with_metadata(latency.latency(run.transactions, keep=["machine"]), run.index, stored=True)
    bins = with_metadata(run.latency_bins, run.index, stored=True)
    found = None
    for keys in (["prefix", "machine"], ["prefix"], ["config_name"]):
        part = stats.percentiles(rows, keys, "latency", _FOUR, method="exact", bins=bins)
        missing = {"prefix": "string", "machine": "int", "config_name": "string"}
        part = part.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in keys})
        found = part if found is None else found.unionByName(part)
    return _experiment(found)


@check(
    "study_latency_single_home",
    f"""with {_RUN_LAT}, t as (select prefix, {_P4} from lat where len(regions) = 1 group by prefix)
    select p90, p95, p99, {_STUDY_INDEX.format("p50")} from t""",
)
def _(v):
    found = studies.latency_study(_study_logs(v, "transactions"), "single", accuracy=EXACT)
    return _experiment(rounded(found, "p50"))


@check(
    "study_throughput_latency",
    f"""with {_RUN_LAT},
    w as (select *, min(sent_at) over (partition by prefix, machine) as lo from runs),
    rate as (select prefix, machine, count(*) as n, max(sent_at) - min(sent_at) as span
             from w where sent_at >= lo + 5000000000 group by 1, 2),
    smp as (select a.prefix, n / committed * 100 as sample
            from (select prefix, count(*) as n from runs group by 1) a
            join (select prefix, sum(committed) as committed from counters group by 1) c
            on a.prefix = c.prefix),
    t as (select substr(rate.prefix, 5, 1) as config_name,
                 sum(rate.n * 1000000000 * (100 / smp.sample) / nullif(span, 0)) as throughput
          from rate join smp on rate.prefix = smp.prefix group by 1)
    select t.config_name, cast(100 as int) as clients, round(throughput, 6) as throughput, p50, p90, p95, p99
    from t join (select config_name, {_P4} from lat group by 1) p on p.config_name = t.config_name""",
)
def _(v):
    run = _study_logs(v, "transactions", "summary")
    found = studies.throughput_latency_study(run, _SHIFTS, method="exact")
    return rounded(found, "throughput")


@check(
    "study_latency_cdfs",
    f"""with {_RUN_LAT}, h as (select *, case when config_name <> 'f' then 'all'
        when len(regions) = 1 then 'single' when len(regions) > 1 then 'multi' else 'all' end as homes from lat)
    select config_name, homes, coordinator_region, latency,
           row_number() over (partition by config_name, homes, coordinator_region order by latency)
           / count(*) over (partition by config_name, homes, coordinator_region) as y
    from h where config_name in ('f', 'o')""",
)
def _(v):
    rows = studies.regional_latency(_study_logs(v, "transactions"), _SHIFTS)
    return studies.latency_cdfs(rows, {"f": 100, "o": 100}, split=["f"])


@check(
    "study_rate",
    f"""with {_RUNS},
    smp as (select a.prefix, n / committed * 100 as sample
            from (select prefix, count(*) as n from runs group by 1) a
            join (select prefix, sum(committed) as committed from counters group by 1) c
            on a.prefix = c.prefix),
    s as (select prefix, cast(floor(sent_at / 1000000000) as bigint) as time, count(*) as n
          from runs group by 1, 2)
    select s.prefix as experiment, time - min(time) over (partition by s.prefix) as time,
           round(n * (100 / sample), 6) as throughput from s join smp on s.prefix = smp.prefix""",
)
def _(v):
    run = _study_logs(v, "transactions", "summary")
    return _experiment(rounded(studies.rate_study(run), "throughput"))


@check(
    "study_comparison",
    f"""with {_RUNS}, {_THEIRS},
    w as (select *, min(sent_at) over (partition by prefix, machine) as lo from runs),
    rate as (select prefix, machine, count(*) as n, max(sent_at) - min(sent_at) as span
             from w where sent_at >= lo + 10000000000 group by 1, 2),
    smp as (select a.prefix, n / committed * 100 as sample
            from (select prefix, count(*) as n from runs group by 1) a
            join (select prefix, sum(committed) as committed from counters group by 1) c
            on a.prefix = c.prefix),
    t as (select substr(rate.prefix, 5, 1) as config_name,
                 sum(rate.n * 1000000000 * (100 / smp.sample) / nullif(span, 0)) as throughput
          from rate join smp on rate.prefix = smp.prefix group by 1),
    o as (select 50 as wl_mh, 1000000 as wl_hot, max(throughput) filter (where config_name = 'f') as f,
                 max(throughput) filter (where config_name = 'o') as o from t)
    select o.wl_mh, o.wl_hot, round(f, 6) as f, round(o.o, 6) as o, round(crossref, 4) as crossref
    from o left join theirs on o.wl_mh = theirs.wl_mh and o.wl_hot = theirs.wl_hot""",
)
def _(v):
    run = _study_logs(v, "transactions", "summary")
    run.index = run.index.withColumns({"wl_mh": F.lit(50), "wl_hot": F.lit(1000000)})
    found, _ = studies.comparison_study(run, v.report, ["f", "o"], "crossref")
    return rounded(rounded(found, "f", "o"), "crossref", digits=4)


@check(
    "study_scaled_comparison",
    f"""with {_RUNS}, {_THEIRS},
    w as (select *, min(sent_at) over (partition by prefix, machine) as lo from runs),
    rate as (select prefix, machine, count(*) as n, max(sent_at) - min(sent_at) as span
             from w where sent_at >= lo + 10000000000 group by 1, 2),
    smp as (select a.prefix, n / committed * 100 as sample
            from (select prefix, count(*) as n from runs group by 1) a
            join (select prefix, sum(committed) as committed from counters group by 1) c
            on a.prefix = c.prefix),
    ours as (select sum(rate.n * 1000000000 * (100 / smp.sample) / nullif(span, 0)) as f
             from rate join smp on rate.prefix = smp.prefix where rate.prefix = 'exp-f-sz5'),
    o as (select 1 / 1000 as hot, cast(null as double) as f_0, f / f as f_50, cast(null as double) as f_100 from ours),
    s as (select wl_mh, 1 / wl_hot as hot, crossref / (select max(crossref) from theirs) as share from theirs),
    p as (select hot, max(share) filter (where wl_mh = 0) as crossref_0,
                 max(share) filter (where wl_mh = 50) as crossref_50,
                 max(share) filter (where wl_mh = 100) as crossref_100 from s group by hot)
    select o.*, round(crossref_0, 8) as crossref_0, round(crossref_50, 8) as crossref_50,
           round(crossref_100, 8) as crossref_100 from o left join p on o.hot = p.hot""",
)
def _(v):
    run = _study_logs(v, "transactions", "summary")
    run.index = run.index.withColumns({"wl_mh": F.lit(50), "wl_hot": F.lit(1000)})
    found = studies.scaled_comparison(run, v.report, "f", "crossref", _MH)
    return rounded(found, "crossref_0", "crossref_50", "crossref_100", digits=8)


@check(
    "study_latency_comparison",
    f"""with {_RUN_LAT},
    t as (select prefix, quantile_disc(latency, 0.5) as p50, quantile_disc(latency, 0.95) as p95,
                 quantile_disc(latency, 0.99) as p99 from lat group by prefix)
    select prefix as experiment, substr(prefix, 5, 1) as config_name, 50 as wl_mh, 1 / 1000 as wl_hot,
           round(p50, 6) as p50, round(p95, 6) as p95, round(p99, 6) as p99 from t
    union all
    select null, 'other', wl_mh, 1 / wl_hot, round(avg(p50), 6), round(avg(p95), 6), round(avg(p99), 6)
    from report group by wl_mh, report.wl_hot""",
)
def _(v):
    run = _study_logs(v, "transactions")
    run.index = run.index.withColumns({"wl_mh": F.lit(50), "wl_hot": F.lit(1000)})
    found = studies.latency_comparison(run, v.report, "other", method="exact")
    kept = ["experiment", "config_name", "wl_mh", "wl_hot", "p50", "p95", "p99"]
    return rounded(_experiment(found).select(*kept), "p50", "p95", "p99")


@check(
    "study_event_rate",
    """with s as (select concat('exp-', region % 2) as experiment, event,
        cast(floor(time / 1000000000) as bigint) as time, count(txn_id) * (100 / 20) as throughput
        from server_events group by 1, 2, 3)
    select experiment, event, time - min(time) over (partition by experiment) as time, throughput from s""",
)
def _(v):
    cols = logs.schemas.names(logs.schemas.SERVER_EVENTS)
    name = F.concat(F.lit("exp-"), F.col("region") % 2)
    rows = _server_rows(v.server_events, cols).withColumn("_experiment", name)
    root = write_tree(rows, "server", "events.csv", cols)
    return _experiment(studies.event_rate_study(RunLogs(v.spark, root), sample=20))


@check(
    "study_deadlocks",
    f"""with d as (select config_name, wl_mh, vertices as x from deadlocks where region = 0 and wl_mh >= 20),
    {_box_sql("d", "config_name, wl_mh")}
    select box.config_name, cast(box.wl_mh as int) as wl_mh, cast(c.committed as bigint) as committed,
           box.n as deadlocks, {_BOX_COLS}, outliers
    from box join (select config_name, wl_mh, sum(committed) as committed
                   from deadlock_summary s join deadlock_experiments e on s.prefix = e.prefix group by 1, 2) c
    on box.config_name = c.config_name and box.wl_mh = c.wl_mh""",
)
def _(v):
    """From a tree with an experiment per configuration and share of multi-home transactions."""
    name = F.element_at(F.split("prefix", "/"), -1)
    cols = ["time", "partition", "region", "vertices"]
    rows = _server_rows(v.deadlocks, ["prefix", *cols]).withColumn("_experiment", name)
    root = write_tree(rows, "server", "deadlocks.csv", cols)
    counters = logs.schemas.names(logs.schemas.SUMMARY)
    sums = v.deadlock_summary.select(
        name.alias("_experiment"), F.col("machine").alias("_directory"), "committed",
        *[F.lit(0).alias(c) for c in counters if c != "committed"],
    )
    write_tree(sums, "client", "summary.csv", counters, root=root)
    meta = v.deadlock_experiments.withColumn("_experiment", name)
    server = meta.withColumn("_directory", F.lit("0-0"))
    write_tree(server, "server", "metadata.csv", ["config_name"], root=root)
    client = meta.select(
        "_experiment", F.lit(0).alias("_directory"), F.col("wl_mh").alias("wl:mh"), F.lit(60).alias("clients")
    )
    write_tree(client, "client", "metadata.csv", ["wl:mh", "clients"], root=root)
    found = studies.deadlock_study(RunLogs(v.spark, root), wl_mh=[20, 30, 40, 50, 60, 70])
    return rounded(found, "q1", "median", "q3", "whisker_low", "whisker_high")


@check(
    "study_graph",
    """select 'exp-sz8' as experiment, time, "partition", region, runtime,
              round(unstable_graph_sz / 1000 - stable_graph_sz / 1000, 6) as unstable_graph_sz,
              stable_graph_sz / 1000 as stable_graph_sz, deadlocks_resolved, graph_update_time
       from resolver where region = 0 and "partition" = 0
            and time >= 820454400000000000 and time < 852076800000000000""",
)
def _(v):
    cols = logs.schemas.names(logs.schemas.RESOLVER)
    rows = _server_rows(v.resolver, cols).withColumn("_experiment", F.lit("exp-sz8"))
    root = write_tree(rows, "server", "deadlock_resolver.csv", cols)
    found = studies.graph_study(
        RunLogs(v.spark, root), "exp-sz8", 820454400000000000, 852076800000000000
    )
    return _experiment(rounded(found, "unstable_graph_sz"))


@check(
    "study_breakdown",
    f"""with {_FACTS}, p as ({_pair_sql("client_events", "txn_id, home, machine")})
    select 'exp' as experiment, p.txn_id, p.home, p.machine, p."from", p."to",
           ("to" - "from") / 1000000 as diff, f.num_regions, f.coordinator_region
    from p join f on p.txn_id = f.txn_id where "from" is not null and "to" is not null""",
)
def _(v):
    name, machine = F.lit("exp").alias("_experiment"), F.col("machine").alias("_directory")
    cols = logs.schemas.names(logs.schemas.CLIENT_EVENTS)
    root = write_tree(v.client_events.select(name, machine, *cols), "client", "txn_events.csv", cols)
    rows = _txn_logs(v).withColumn("_experiment", F.lit("exp"))
    write_tree(rows, "client", "transactions.csv", _TXN_COLS, root=root)
    found = studies.breakdown_study(RunLogs(v.spark, root), "click", "purchase", name="exp")
    return _experiment(found).select(
        "experiment", "txn_id", "home", "machine", "from", "to", "diff",
        F.col("num_regions").cast("long").alias("num_regions"), "coordinator_region",
    )


def _event_tree(v):
    """A tree of one experiment with client events and their transactions."""
    name, machine = F.lit("exp").alias("_experiment"), F.col("machine").alias("_directory")
    cols = logs.schemas.names(logs.schemas.CLIENT_EVENTS)
    root = write_tree(v.client_events.select(name, machine, *cols), "client", "txn_events.csv", cols)
    rows = _txn_logs(v).withColumn("_experiment", F.lit("exp"))
    return write_tree(rows, "client", "transactions.csv", _TXN_COLS, root=root)


_BREAKDOWNS = f"""with {_FACTS}, p as ({_pairs_sql("client_events", "txn_id, home, machine")})
    select 'exp' as experiment, p.*, f.num_regions, f.coordinator_region
    from p join f on p.txn_id = f.txn_id"""


def _breakdown_columns(df):
    return df.withColumn("num_regions", F.col("num_regions").cast("long")).select(
        "experiment", "txn_id", "home", "machine", "pair", "from", "to", "diff", "num_regions",
        "coordinator_region",
    )


@check("study_breakdowns", _BREAKDOWNS)
def _(v):
    run = RunLogs(v.spark, _event_tree(v))
    return _breakdown_columns(studies.breakdowns_study(run, _PAIRS, names=["exp"]))


@check("event_pairs_in_buckets", _BREAKDOWNS)
def _(v):
    """From stored events and transactions that lie together by transaction."""
    store_path = f"{store.scratch_dir(v.spark)}/store-{uuid.uuid4().hex}"
    run = RunLogs(v.spark, _event_tree(v), store=store_path)
    found = events.event_pairs(
        run.by_transaction("client_events", 8), _PAIRS, run.by_transaction("transactions", 8),
        by=["home", "machine"],
    )
    return _breakdown_columns(_experiment(found))


@check(
    "study_deadlock_totals",
    """select concat('exp-mh', wl_mh) as experiment, cast(wl_mh as int) as mh, count(*) as deadlock_cnt,
              cast(sum(vertices) as bigint) as deadlock_sz from deadlocks where region = 0 group by wl_mh""",
)
def _(v):
    cols = ["time", "partition", "region", "vertices"]
    name = F.concat(F.lit("exp-mh"), F.col("wl_mh")).alias("_experiment")
    rows = _server_rows(v.deadlocks, ["wl_mh", *cols]).withColumn("_experiment", name)
    root = write_tree(rows, "server", "deadlocks.csv", cols)
    meta = v.deadlocks.select(name).distinct()
    server = meta.select("*", F.lit("0-0").alias("_directory"), F.lit("a.conf").alias("config_name"))
    client = meta.select("*", F.lit(0).alias("_directory"), F.lit(3000).alias("clients"))
    write_tree(server, "server", "metadata.csv", ["config_name"], root=root)
    write_tree(client, "client", "metadata.csv", ["clients"], root=root)
    run = RunLogs(v.spark, root, tags={"mh": r"mh(\d+)"})
    return _experiment(studies.deadlock_totals_study(run, "mh", clients=3000))


@check(
    "materialize",
    f"with {WINDOWED} select prefix, machine, round(throughput, 6) as throughput from rates",
)
def _(v):
    path = f"{store.scratch_dir(v.spark)}/result-{uuid.uuid4().hex}"

    def compute():
        found = throughput.throughput(v.txns, v.summary, per_machine=True, **WINDOW)
        return rounded(found, "throughput")

    def not_again():
        raise AssertionError("the stored result must be used")

    store.materialize(v.spark, path, compute)
    return store.materialize(v.spark, path, not_again)
