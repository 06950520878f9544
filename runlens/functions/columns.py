"""Column expressions on transactions."""

from pyspark.sql import functions as F

from runlens.schemas import REGION_SHIFT


def parse_id_list(text, sort=True):
    """``"3;1"`` to ``[1, 3]``; an element that is no number becomes null (last if sorted)."""
    ids = F.transform(F.split(text, ";"), lambda x: x.try_cast("int"))
    return F.array_sort(ids) if sort else ids


def packed_region(coordinator="coordinator", shift=24):
    """P5: the region in the high bits of a coordinator id."""
    return F.shiftright(F.col(coordinator), shift)


def coordinator_region(df, shifts=None, config="config_name", coordinator="coordinator"):
    """P5: the region of the coordinator, by the rule of the row's configuration.

    ``shifts`` maps a configuration to its number of low bits; for all others the id divided by
    four, cut to a whole number, is the region. Names count with or without ``.conf``.
    """
    region, plain = None, F.regexp_replace(F.col(config), r"\.conf", "")
    for conf, bits in (REGION_SHIFT if shifts is None else shifts).items():
        shifted = F.shiftright(F.col(coordinator), bits)
        matches = plain == conf.replace(".conf", "")
        region = F.when(matches, shifted) if region is None else region.when(matches, shifted)
    quarter = (F.col(coordinator) / 4).cast("int")
    return df.withColumn(
        "coordinator_region", quarter if region is None else region.otherwise(quarter)
    )


def single_home(regions="regions"):
    """The transaction touches one region."""
    return F.size(regions) == 1


def multi_home(regions="regions"):
    """The transaction touches several regions."""
    return F.size(regions) > 1


def txn_class(df, regions="regions", partitions="partitions"):
    """The numbers of regions and partitions a transaction touches."""
    return df.withColumns({"num_regions": F.size(regions), "num_partitions": F.size(partitions)})


def other_region(df, regions="regions", coordinator="coordinator_region", name="other_region"):
    """The first region of a transaction that is not its coordinator's; null if none."""
    others = F.filter(F.col(regions), lambda x: x != F.col(coordinator))
    return df.withColumn(name, F.try_element_at(others, F.lit(1)))


def ms_between(start, end):
    """Milliseconds between two nanosecond columns."""
    return (F.col(end) - F.col(start)) / 1000000
