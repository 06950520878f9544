"""The index of experiments."""

from functools import reduce

from pyspark.sql import functions as F

from runlens.functions.paths import with_prefix
from runlens.schemas import METADATA_INTS
from runlens.sources.logs import client_path, server_path
from runlens.sources.store import settle


_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'  # outside of quotes


def _cells(line):
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), '""', '"')
    return F.transform(F.split(line, _COMMA), bare)


def _metadata(spark, path, check_header):
    """The distinct metadata rows of each experiment, each file's values bound by its own header.

    The files are tiny, and their column names are all that comes to the driver.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x != "")
    files = with_prefix(spark.read.text(path, wholetext=True)).withColumn("_lines", lines)
    rows = files.where(F.size("_lines") > 0).select(
        "prefix",
        F.transform(_cells(F.col("_lines")[0]), lambda x: F.regexp_replace(x, ":", "_")).alias("_names"),
        F.explode_outer(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(1)))).alias("_line"),
    )
    rows = settle(rows, "metadata")  # each file is opened once
    named = rows.select("_names").distinct().select(F.posexplode("_names").alias("i", "name"))
    order = (
        named.groupBy("name")
        .agg(F.min("i").alias("i"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n"))
        .orderBy("i", "name")
        .collect()
    )
    if check_header and any(r.n > 1 or r.i != r.last for r in order):
        raise ValueError(f"the metadata files at {path} have different columns")
    own = F.slice(_cells("_line"), 1, F.size("_names"))
    cells = F.map_from_entries(F.arrays_zip("_names", own))
    values = rows.where("_line is not null").select("prefix", cells.alias("_cells"))
    return values.select(
        "prefix", *[F.nullif(F.col("_cells")[r.name], F.lit("")).alias(r.name) for r in order]
    ).distinct()


def _one_per_prefix(df, conflicts, side):
    """Settle experiments whose machines wrote different metadata."""
    if conflicts == "keep":
        return df
    rest = [c for c in df.columns if c != "prefix"]
    grouped = df.groupBy("prefix").agg(
        F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    if conflicts == "raise":
        message = F.concat(F.lit(f"machines disagree on {side} metadata: "), F.col("prefix"))
        checked = F.when(F.col("_rows") == 1, F.col("_first"))
        checked = checked.otherwise(F.raise_error(message))
        grouped = grouped.withColumn("_first", checked)
    return grouped.select("prefix", *[F.col(f"_first.`{c}`").alias(c) for c in rest])


def experiment_index(spark, root, experiment="*", conflicts="raise", check_header=False):
    """One row per experiment with the metadata of its servers and clients.

    Colons in column names become underscores (``wl:mh`` to ``wl_mh``) and known numbers become
    ints. A column that both sides have keeps its name on the server side and is ``client_...`` on
    the other. All machines of an experiment should hold the same metadata; if they do not,
    ``conflicts`` says whether to ``raise``, to take the ``first``, or to ``keep`` a row for each,
    which multiplies the rows of joins by ``prefix``. Values bind by the names in their file's
    header, whatever its order; ``check_header`` raises where headers differ.
    """
    if conflicts not in ("keep", "first", "raise"):
        raise ValueError("conflicts must be 'keep', 'first' or 'raise'")
    sides = {}
    for side, path in (("server", server_path), ("client", client_path)):
        rows = _metadata(spark, path(root, experiment, "metadata.csv"), check_header)
        sides[side] = _one_per_prefix(rows, conflicts, side)
    shared = set(sides["server"].columns) & set(sides["client"].columns) - {"prefix"}
    client = sides["client"].withColumnsRenamed({c: f"client_{c}" for c in shared})
    index = sides["server"].join(client, "prefix")
    ints = [c for c in METADATA_INTS if c in index.columns]
    return reduce(lambda df, c: df.withColumn(c, F.col(c).try_cast("int")), ints, index)
