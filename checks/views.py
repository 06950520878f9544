"""Log-shaped views over the given tables, for Spark and for DuckDB from one text.

Three spellings differ: NS(x) is nanoseconds since 1970, SETOF(x) the sorted list of distinct
values, Q(x) a quoted name. Order dates are whole days, so a day is counted as a second.
"""

import re
from functools import lru_cache

VIEWS = {
    "base": """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       concat('run/', lower(o_orderstatus), '-sz', cast(3 + (o_custkey % 3) * 4 as string), 'mh',
              substr(o_orderpriority, 1, 1)) as prefix,
       cast(o_custkey % 8 as int) as machine,
       concat(lower(o_orderstatus), '.conf') as config_name,
       cast((3 + (o_custkey % 3) * 4) * 50 as int) as clients,
       cast(case o_custkey % 3 when 0 then 1000000 when 1 then 1000 else 10 end as int) as wl_hot,
       cast(substr(o_orderpriority, 1, 1) as int) * 10 as wl_mh
from orders""",
    "lines": """
select l_orderkey, SETOF(cast(l_suppkey % 8 as int)) as regions,
       SETOF(cast(l_partkey % 4 as int)) as partitions
from lineitem group by l_orderkey""",
    "txns": """
select b.prefix, b.machine, b.o_orderkey as txn_id,
       cast((b.o_custkey % 8) * 16777216 + b.o_orderkey % 4 as int) as coordinator,
       l.regions, l.partitions,
       NS(b.o_orderdate) / 86400 + b.o_orderkey * 1000000 as sent_at,
       NS(b.o_orderdate) / 86400 + b.o_orderkey * 1000000 + b.o_totalprice * 1000 as received_at
from base b join lines l on l.l_orderkey = b.o_orderkey""",
    "experiments": """
select distinct prefix, config_name, clients, wl_hot, wl_mh from base""",
    "summary": """
select prefix, machine, count(*) * 5 as committed,
       cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as aborted,
       cast((max(NS(o_orderdate)) - min(NS(o_orderdate))) / 86400 as bigint) as elapsed_time
from base group by prefix, machine""",
    "client_events": """
select user_id as txn_id, event_type as event, cast(NS(ts) as double) as time,
       cast(floor(event_id / 4) as int) % 8 as machine, cast(event_id % 4 as int) as home, event_id
from events""",
    "server_events": """
select event_id as txn_id, event_type as event, cast(NS(ts) as double) as time,
       cast(event_id % 4 as int) as Q(partition), cast(user_id % 8 as int) as region
from events""",
    "timestamps": """
select event_id as txn_id, cast(user_id as int) as Q(from), NS(ts) as txn_timestamp,
       NS(ts) - cast(floor(value * 1000) as bigint) * 1000 as server_time,
       cast(event_id % 4 as int) as Q(partition), cast(user_id % 8 as int) as region
from events""",
    "measurements": """
select cast(event_id % 3 as int) as type, NS(ts) as time, cast(floor(value * 1000) as bigint) as data,
       cast(event_id % 4 as int) as Q(partition), cast(user_id % 8 as int) as region
from events""",
    "link_latency": """
select concat('node', cast(user_id % 8 as string)) as src, cast(event_id % 8 as int) as dst,
       NS(ts) as send_time, NS(ts) + cast(floor(value * 1000) as bigint) * 1000 as recv_time,
       cast(floor(value * 1000) as bigint) as avg_latency
from events""",
    "deadlocks": """
select concat('run/', lower(l_returnflag), lower(l_linestatus), '-mh', cast(l_linenumber * 10 as string))
         as prefix,
       concat(lower(l_returnflag), lower(l_linestatus), '.conf') as config_name,
       l_linenumber * 10 as wl_mh, NS(l_shipdate) as time, cast(l_suppkey % 4 as int) as Q(partition),
       cast(l_partkey % 3 as int) as region, cast(floor(l_quantity) as int) as vertices,
       cast(l_suppkey % 8 as int) as machine
from lineitem""",
    "deadlock_experiments": """
select distinct prefix, config_name, 100 as wl_hot, 100 as wl_mp, wl_mh from deadlocks""",
    "deadlock_summary": """
select prefix, machine, count(*) * 5 as committed from deadlocks group by prefix, machine""",
    "report": """
select (l_linenumber % 3) * 50 as wl_mh,
       cast(case l_suppkey % 3 when 0 then 1000000 when 1 then 1000 else 10 end as int) as wl_hot,
       concat('r', cast(l_suppkey % 6 as string)) as region,
       case when l_returnflag = 'R' then 'deadlock' when l_returnflag = 'A' then 'write'
            when l_linestatus = 'O' then 'too-old' else 'other' end as type,
       cast(floor(l_quantity) as int) as count, l_extendedprice as throughput, l_tax * 1000 as avg,
       l_discount * 1000 as p50, l_discount * 2000 as p95, l_discount * 3000 + l_tax as p99,
       l_discount * 4000 as pMax
from lineitem""",
    "resolver": """
select NS(l_shipdate) as time, cast(l_suppkey % 4 as int) as Q(partition),
       cast(l_partkey % 8 as int) as region, l_orderkey as runtime,
       cast(floor(l_extendedprice) as int) as unstable_graph_sz,
       cast(floor(l_quantity) as int) as stable_graph_sz, l_linenumber as deadlocks_resolved,
       cast(l_partkey % 100 as int) as graph_update_time
from lineitem""",
}

TABLES = ["orders", "lineitem", "events"]

_SPARK = {
    r"NS\(([\w.]+)\)": r"(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', \1) * 1000)",
    r"SETOF\((cast\([^)]*\))\)": r"array_sort(collect_set(\1))",
    r"Q\((\w+)\)": r"`\1`",
}
_DUCK = {
    r"NS\(([\w.]+)\)": r"(epoch_us(\1) * 1000)",
    r"SETOF\((cast\([^)]*\))\)": r"list_sort(list(distinct \1))",
    r"Q\((\w+)\)": r'"\1"',
}


def _spell(text, rules):
    for pattern, spelling in rules.items():
        text = re.sub(pattern, spelling, text)
    return text


def _sources(text):
    """Views and tables a text reads, in the order of their definition."""
    used = set(re.findall(r"(?:from|join) (\w+)", text))
    return [name for name in [*TABLES, *VIEWS] if name in used]


@lru_cache(maxsize=None)
def _schema(spark, path):
    return spark.read.parquet(path).schema


def view(spark, sf_dir, name):
    """One view (or given table) as a DataFrame."""
    if name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        return spark.read.schema(_schema(spark, path)).parquet(path)
    text = VIEWS[name]
    inputs = {source: view(spark, sf_dir, source) for source in _sources(text)}
    for source in inputs:
        text = re.sub(rf"(from|join) {source}\b", rf"\1 {{{source}}}", text)
    return spark.sql(_spell(text, _SPARK), **inputs)


def with_views(sql):
    """``sql`` with the views it reads written out as common table expressions, for DuckDB."""
    needed, queue = set(), _sources(sql)
    while queue:
        name = queue.pop()
        if name in VIEWS and name not in needed:
            needed.add(name)
            queue += _sources(VIEWS[name])
    ctes = [f"{name} as ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    body = sql.strip()
    if body.startswith("with "):
        body = body[5:]
        return _spell("with " + ",\n".join(ctes) + ",\n" + body, _DUCK)
    return _spell("with " + ",\n".join(ctes) + "\n" + body, _DUCK) if ctes else body
