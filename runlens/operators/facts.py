"""Facts of a group on each of its rows, without gathering the group in one task."""

from functools import reduce

from pyspark.sql import functions as F

from runlens.sources.store import settle


def attach(df, facts, keys, how="inner", stored=False):
    """Join ``facts`` (one row per key) to ``df``.

    The facts are settled first, unless they are ``stored`` already. Their real size then decides
    the join: below the broadcast threshold the rows of ``df`` stay where they are; beyond it both
    sides are shuffled and adaptive execution splits the heavy keys. Null keys match each other,
    as in a window. Without keys the facts are a single row, whose values become constants.
    """
    small = facts if stored else settle(facts, "facts")
    if not keys:
        return df.withColumns({c: small.select(c).scalar() for c in small.columns})
    marked = {key: f"__{key}" for key in keys}
    right = small.withColumnsRenamed(marked)
    same = reduce(
        lambda a, b: a & b, [df[key].eqNullSafe(right[mark]) for key, mark in marked.items()]
    )
    return df.join(right, same, how).drop(*marked.values())


def with_metadata(df, index, condition=None, how="inner", stored=False):
    """Join the index of experiments to rows of their logs.

    The index is settled first unless it is ``stored``, so that its real size decides the join.
    ``condition`` picks experiments on the stored index; on logs that are laid out by experiment
    Spark then skips the others' files.
    """
    small = index if stored else settle(index, "index")
    return df.join(small if condition is None else small.where(condition), "prefix", how)


def with_facts(df, keys, aggs):
    """``df`` with one more column per aggregate of its group; no keys means the whole table.

    A window over ``keys`` would move every row and put a heavy key into one task; here the
    aggregate is combined before its small shuffle.
    """
    facts = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return attach(df, facts, keys)


def run_keys(*dfs):
    """The experiment as a key, if all the tables know theirs."""
    return ["prefix"] if all("prefix" in df.columns for df in dfs) else []


def cell(value, agg=None):
    """The aggregate of a pivoted cell: its one value, or ``agg`` of several.

    Without ``agg`` a cell with more than one row raises, since any choice would lose rows.
    """
    if agg is not None:
        return agg(value)
    rows = F.count(F.when(F.col(value).isNotNull(), F.lit(1)))
    message = f"a cell of the table has several rows of {value}; name an aggregate"
    return F.when(rows > 1, F.raise_error(F.lit(message))).otherwise(F.max(value))


def as_list(keys):
    return [keys] if isinstance(keys, str) else list(keys or [])
