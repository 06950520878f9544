"""What the readers could not read: a side table of the lines with malformed fields.

The readers turn malformed values into nulls. Here the same logs are read as text, each field is
held against the layout, and the lines that do not fit come with their file and the reasons.
"""

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from runlens import schemas
from runlens.functions.paths import prefix_of
from runlens.sources.logs import FILES, log_paths

LAYOUTS = {
    "transactions": schemas.TRANSACTIONS,
    "summary": schemas.SUMMARY,
    "deadlocks": schemas.DEADLOCKS,
    "txn_timestamps": schemas.TXN_TIMESTAMPS,
    "measurements": schemas.MEASUREMENTS,
    "client_events": schemas.CLIENT_EVENTS,
    "server_events": schemas.SERVER_EVENTS,
    "link_latency": schemas.LINK_LATENCY,
    "resolver": schemas.RESOLVER,
}
#: Text fields that hold lists of numbers.
LISTS = {"transactions": ("regions", "partitions", "global_log_pos")}
_RECORD = "_record"


def _is_number(value, kind):
    fits = value.try_cast(kind).isNotNull()
    return fits & value.rlike(r"^[+-]?\d+$") if kind in ("int", "bigint") else fits


def _fault(name, kind, lists):
    """Why a field does not fit; null if it does. Empty fields are nulls, not faults."""
    value = F.col(f"`{name}`")
    if name in lists:
        odd = F.filter(F.split(value, ";"), lambda x: ~_is_number(x, "int"))
        return F.when(F.size(odd) > 0, F.concat(F.lit(f"{name}: no number in the list")))
    if kind == "string":
        return F.lit(None).cast("string")
    return F.when(value.isNotNull() & ~_is_number(value, kind), F.lit(f"{name}: no {kind}"))


def corrupt_lines(spark, root, name, experiment="*", layout=None, directory="*"):
    """(prefix, file, record, reasons) of the lines of a log that do not fit its layout.

    ``name`` is a log as in ``LAYOUTS``; ``layout`` replaces its fields, for logs of an old
    layout. A line with too few or too many fields has that as its one reason; else each field that
    the reader makes null is a reason. ``record`` is the line's text, with its fields written anew
    where their number is right.
    """
    side, file = FILES[name]
    fields = StructType.fromDDL(layout or LAYOUTS[name]).fields
    texts = StructType([StructField(f.name, StructType.fromDDL("x string")[0].dataType) for f in fields])
    path = log_paths(root, experiment, side, directory, file)
    rows = (
        spark.read.schema(texts.add(_RECORD, "string"))
        .option("header", True)
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("columnPruning", False)
        .csv(path)
    )
    lists = LISTS.get(name, ()) if layout is None else ()
    faults = F.array_compact(
        F.array(*[_fault(f.name, f.dataType.simpleString(), lists) for f in fields])
    )
    reasons = F.when(F.col(_RECORD).isNotNull(), F.array(F.lit("number of fields"))).otherwise(faults)
    line = F.coalesce(_RECORD, F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in fields])))
    path = F.col("_metadata.file_path")
    return rows.select(
        prefix_of(path).alias("prefix"), path.alias("file"), line.alias("record"), reasons.alias("reasons")
    ).where(F.size("reasons") > 0)


def corrupt_counts(spark, root, names=tuple(LAYOUTS), experiment="*"):
    """(log, prefix, file, reason, n): how many lines of each file do not fit, and why.

    A log that none of the experiments has is left out.
    """
    found = None
    for name in names:
        try:
            lines = corrupt_lines(spark, root, name, experiment)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                continue
            raise
        lines = lines.select(F.lit(name).alias("log"), "prefix", "file", F.explode("reasons").alias("reason"))
        found = lines if found is None else found.unionByName(lines)
    if found is None:
        return spark.createDataFrame([], "log string, prefix string, file string, reason string, n long")
    return found.groupBy("log", "prefix", "file", "reason").agg(F.count(F.lit(1)).alias("n"))
