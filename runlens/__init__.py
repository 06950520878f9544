"""runlens: PySpark operators for the logs of distributed-database benchmark runs."""

from runlens.functions.columns import (
    coordinator_region,
    multi_home,
    other_region,
    packed_region,
    parse_id_list,
    single_home,
    txn_class,
)
from runlens.functions.paths import (
    config_label,
    experiment_name,
    tag_from_name,
    with_prefix,
    with_server_fields,
    with_source_fields,
)
from runlens.operators.clocks import clock_deviation, with_deviation
from runlens.operators.deadlocks import deadlock_profile, deadlock_totals, graph_size_series
from runlens.operators.events import (
    diff_series,
    event_diff,
    event_diff_server,
    events_latency,
    hop_diff,
    region_counts,
    slow_events,
)
from runlens.operators.frames import axis_values, series, throughput_wide
from runlens.operators.latency import (
    latency,
    latency_by_region,
    latency_percentiles,
    named,
    single_home_percentiles,
    stratified_percentiles,
    throughput_latency_curve,
)
from runlens.operators.reports import (
    compare_systems,
    outcome_counts_wide,
    outcome_mix,
    outcome_pct_wide,
    relative_to,
    report_latency,
    report_throughput,
    scale_by_max_wide,
    stack_systems,
)
from runlens.operators.sampling import fixed_sample, sample_rows, stratified_sample
from runlens.operators.stats import (
    box_stats,
    cdf,
    drop_constant_columns,
    gaps,
    min_max_scale,
    percentiles,
    shift_to_zero,
)
from runlens.operators.throughput import (
    committed,
    counter_throughput,
    event_throughput,
    sample_rate,
    throughput,
    throughput_by_experiment,
    throughput_over_time,
)
from runlens.operators.window import run_window
from runlens.plans.logs import RunLogs
from runlens.session import get_session
from runlens.sources.archive_format import load_archived, register_archives
from runlens.sources.archives import archived_table, read_archived, read_archives
from runlens.sources.index import experiment_index
from runlens.sources.logs import (
    read_client_events,
    read_deadlocks,
    read_link_latency,
    read_measurements,
    read_resolver,
    read_server_events,
    read_summary,
    read_transactions,
    read_txn_timestamps,
)
from runlens.sources.reports import read_latency_report, read_report
from runlens.sources.store import clear_scratch, materialize, scratch, settle

__all__ = [name for name in dir() if not name.startswith("_")]
