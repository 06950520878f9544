"""Fields that live in the path of a log file or in the name of an experiment."""

from itertools import chain

from pyspark.sql import functions as F

# A log lies at {prefix}/{client or server}/{directory}/{file}; the file may be a folder of parts.
_LOG_PATH = r"^(.*)/(client|server)/([^/]+)/"


def prefix_of(path):
    """The experiment directory of a log path."""
    return F.nullif(F.regexp_extract(path, _LOG_PATH, 1), F.lit(""))


def directory_of(path):
    """The directory that names the machine of a log path."""
    return F.nullif(F.regexp_extract(path, _LOG_PATH, 3), F.lit(""))


def _file_path():
    return F.col("_metadata.file_path")


def with_prefix(df, path=None):
    """The experiment of each row, from the path of its file."""
    return df.withColumn("prefix", prefix_of(_file_path() if path is None else path))


def with_source_fields(df, name="machine", kind="int", path=None):
    """The experiment and the machine directory of each row, from the path of its file.

    ``df`` must be a file scan unless ``path`` gives the path column.
    """
    path = _file_path() if path is None else path
    return df.withColumns(
        {"prefix": prefix_of(path), name: directory_of(path).try_cast(kind)}
    )


def with_server_fields(df, path=None):
    """The experiment, region and partition from ``{region}-{partition}``."""
    path = _file_path() if path is None else path
    parts = F.split(directory_of(path), "-")
    return df.withColumns(
        {
            "prefix": prefix_of(path),
            "region": F.try_element_at(parts, F.lit(1)).try_cast("int"),
            "partition": F.try_element_at(parts, F.lit(2)).try_cast("int"),
        }
    )


def experiment_name(prefix="prefix", depth=1):
    """The experiment without the root its logs lie under: the last ``depth`` parts of its path.

    Copies of a log tree agree in it, wherever they lie. ``depth`` is above 1 where experiments
    are nested, as those of the glob ``"batch*/*"`` are.
    """
    # The pattern meets the end of the path only: over the whole path its work would grow with the
    # square of the root's length.
    path = F.col(prefix) if isinstance(prefix, str) else prefix
    end = F.substring_index(F.rtrim(path, F.lit("/")), "/", -depth)
    return F.regexp_extract(end, r"((?:[^/]+/){0,%d}[^/]+)/*$" % (depth - 1), 1)


def tag_from_name(df, name, pattern, source="prefix", depth=1):
    """The number that ``pattern`` captures in the experiment name; null if it is not there.

    The root of the logs is not searched.
    """
    found = F.regexp_extract(experiment_name(source, depth), pattern, 1)
    return df.withColumn(name, found.try_cast("int"))


def config_label(df, labels=None, config="config_name", name=None):
    """Drop ``.conf`` (anywhere in the name) and, given ``labels``, look up the label.

    ``labels`` maps configuration names, with or without ``.conf``, to labels; names that it does
    not hold keep their own text.
    """
    plain = F.regexp_replace(F.col(config), r"\.conf", "")
    if labels:
        pairs = {key.replace(".conf", ""): label for key, label in labels.items()}
        table = F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs.items())])
        plain = F.coalesce(F.try_element_at(table, plain), plain)
    return df.withColumn(name or config, plain)
