"""Summary reports of another system."""

from runlens import schemas
from runlens.sources.logs import scan


def read_report(spark, path, check_header=False):
    """Outcomes, throughput and latency per workload and region."""
    return scan(spark, path, schemas.REPORT, check_header)


def read_latency_report(spark, path, check_header=False):
    """Latency per workload and region."""
    return scan(spark, path, schemas.LATENCY_REPORT, check_header)
