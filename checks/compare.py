"""Run the queries against their SQL: ``python -m checks.compare [sf_dir] [query ...]``.

``CONF="name=value ..."`` sets more session settings, for example
``spark.sql.autoBroadcastJoinThreshold=-1`` to take the way of tables too large to broadcast.
"""

import glob
import os
import sys
import time
from collections import Counter

import duckdb

from checks.queries import ORACLES, QUERIES
from runlens.session import get_session


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(row[i] for i in order) for row in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def compare(df, con, name):
    """None if the result of a query and its SQL agree, else what differs."""
    ours = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return None
    found = con.execute(ORACLES[name])
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    kinds = {c: t for c, t in df.dtypes}
    theirs_kinds = {d[0]: str(d[1]).lower() for d in found.description}
    names = {"integer": "int", "varchar": "string"}
    odd = {c: (kinds[c], k) for c, k in theirs_kinds.items() if names.get(k, k) != kinds[c]}
    if odd:
        return f"types {odd}"
    if ours[1] != theirs[1]:
        left, right = list((ours[1] - theirs[1]).items()), list((theirs[1] - ours[1]).items())
        counts = f"{sum(ours[1].values())}/{sum(theirs[1].values())}"
        samples = [sorted(side, key=str)[:2] for side in (left, right)]
        return f"rows {counts}, differ {len(left)}/{len(right)}: {samples}"
    return None


def session():
    spark = get_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            **dict(pair.split("=", 1) for pair in os.environ.get("CONF", "").split() if pair),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = session()
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(QUERIES[name](spark, sf_dir), con, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
