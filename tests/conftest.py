import os

import pytest

from runlens.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "runlens-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


TXN_HEADER = (
    "txn_id,coordinator,regions,partitions,generator,restarts,global_log_pos,sent_at,received_at"
)
SUMMARY_HEADER = (
    "committed,aborted,not_started,restarted,single_home,multi_home,single_partition,"
    "multi_partition,remaster,elapsed_time"
)


@pytest.fixture(scope="session")
def tree(tmp_path_factory):
    """Two experiments with two client machines and two servers each."""
    root = str(tmp_path_factory.mktemp("logs"))
    for name, config, clients in (
        ("alpha-sz3-asym_ratio60", "first.conf", 200),
        ("base-sz19", "second.conf", 3000),
    ):
        for machine in (0, 1):
            client = f"{root}/{name}/client/{machine}"
            write(
                f"{client}/metadata.csv",
                "duration,txns,clients,rate,sample,wl:hot,wl:mh,wl:mp",
                f"60,0,{clients},0,10,1000,50,0",
            )
            rows = [
                "1,16777216,1;0,2;1,0,0,9;4,1000000000,1005000000",
                "2,33554432,2,0,0,1,,12000000000,12030000000",
                "3,16777217,1;x,,0,0,7,21000000000,21001000000",
                "4,0,0,1,0,0,7,,21001000000",
            ]
            # The second machine of the second experiment sent one transaction.
            alone = name.startswith("base") and machine == 1
            write(f"{client}/transactions.csv", TXN_HEADER, *(rows[:1] if alone else rows))
            write(
                f"{client}/summary.csv", SUMMARY_HEADER, "30,1,0,0,10,20,5,25,0,20000000000"
            )
            write(
                f"{client}/txn_events.csv",
                "txn_id,event,time,machine,home",
                f"1,ENTER_WORKER,1000000,{machine},0",
                f"1,ENTER_WORKER,3000000,{machine},0",
                f"1,EXIT_WORKER,9000000,{machine},0",
                f"2,ENTER_WORKER,5000000,{machine},1",
            )
        for server in ("0-0", "1-0"):
            path = f"{root}/{name}/server/{server}"
            region = server[0]
            write(f"{path}/metadata.csv", "config_name", config)
            write(
                f"{path}/deadlocks.csv",
                "time,partition,replica,vertices",
                f"100,0,{region},4",
                f"200,0,{region},6",
            )
            write(
                f"{path}/txn_timestamps.csv",
                "txn_id,from,txn_timestamp,server_time",
                "1,0,5000000,3000000",
                "2,0,bad,3000000",
            )
            write(f"{path}/generic.csv", "type,time,data,partition,region", f"2,5,7000000,0,{region}")
            write(
                f"{path}/events.csv",
                "txn_id,event,time,partition,region",
                f"1,ENTER_SERVER,1500000000,0,{region}",
                f"2,ENTER_SERVER,1900000000,0,{region}",
                f"2,ENTER_SERVER,2100000000,0,{region}",
            )
            write(
                f"{path}/forw_sequ_latency.csv",
                "dst,send_time,recv_time,avg_latency",
                "1,10,30,20",
            )
            write(
                f"{path}/deadlock_resolver.csv",
                "time,partition,region,runtime,unstable_graph_sz,stable_graph_sz,"
                "deadlocks_resolved,graph_update_time",
                f"10,0,{region},5,5000,2000,1,3",
                f"20,0,{region},5,6000,2500,1,3",
            )
    return root
