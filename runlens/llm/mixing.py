"""Mixing sources to target weights by systematic sampling, with DataFrame functions alone.

A source's target is its weight's share of all words, at most ``max_repeats`` times its own size;
what is cut off is shared by weight among the others until none is above. In a source the
documents are ordered by (size, doc_id), each adds its expected copies to a running sum, the
source's one random offset is added, and a document is emitted once per integer crossed. Since
neighbours have like sizes, the words taken differ from the target by about one document.

The running sum spans a source of any size: rows are range-shuffled by (source, size, doc_id),
numbered in their piece, and a small table of pieces links the pieces (``ordering.ranked``).
Sums are whole numbers of 2**-24 copies, so that reruns and other engines agree.

Defined results: a null text has size 0 and takes nothing; the null source is a source, the last
one; a source without words has target 0; rows that agree in (source, size, doc_id) share their
copies in any order; other columns never matter.
"""

from pyspark.sql import functions as F

from runlens.operators.facts import attach
from runlens.operators.ordering import accumulated, ranked, spread
from runlens.sources.store import settle

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
_UNIT = 1 << 24


def _big(col):
    return F.col(col).cast("decimal(38,0)")


def source_targets(sizes, weights=WEIGHTS, max_repeats=3):
    """One row per source of ``sizes`` (_source, _size): source_size, target and step.

    ``step`` is the expected copies of a document in units of 2**-24. Sources that reach their
    bound are those of the smallest bound per weight, so one running sum finds where to stop.
    """
    own = sizes.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    placed = ranked(own, [], [F.col("_source").asc_nulls_last()])
    number = (F.col("_rank") - 1) % len(weights)
    weighted = placed.select(
        "_source",
        "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), (number + 1).cast("int"))
        .cast("long")
        .alias("weight"),
        (F.col("source_size") * max_repeats).alias("cap"),
        "_rank",
    ).withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
    order = ["fill", "_rank"]
    pieces = spread(weighted, [], order)
    caps = accumulated(pieces, [], order, "cap").select(
        "_rank", (F.col("_upto") - F.col("cap")).alias("caps_before")
    )
    sums = (
        accumulated(pieces, [], order, "weight")
        .withColumn("weight_left", F.col("_total") - F.col("_upto") + F.col("weight"))
        .join(caps, "_rank")
    )
    total = settle(own.agg(F.sum("source_size").alias("all_sizes")), "total")
    open_ = attach(sums, total, [], stored=True).where(
        _big("cap") * _big("weight_left")
        >= _big("weight") * (_big("all_sizes") - _big("caps_before"))
    )
    level = open_.agg(
        F.min(
            F.struct(
                "fill",
                "_rank",
                (F.col("all_sizes") - F.col("caps_before")).alias("rest"),
                "weight_left",
            )
        ).alias("at")
    ).select(F.col("at.rest").alias("rest"), F.col("at.weight_left").alias("over"))
    full = _big("cap") * _big("over") <= _big("weight") * _big("rest")
    share = (F.col("weight") * F.col("rest")).cast("double") / F.col("over").cast("double")
    target = F.when(full, F.col("cap").cast("double")).otherwise(share)
    step = F.floor(F.try_divide(F.col("target"), F.col("source_size")) * _UNIT).cast("long")
    return (
        attach(weighted, level, [])
        .withColumn("target", target)
        .select("_source", "source_size", "target", F.coalesce(step, F.lit(0)).alias("step"))
    )


def offset(source, seed="mix"):
    """The source's random offset, in units of 2**-24."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def planned(docs, weights=WEIGHTS, max_repeats=3, seed="mix", row=None):
    """doc_id, size, source_size, target, copies of each document, and ``row`` if it is given."""
    kept = [row.alias("_row")] if row is not None else []
    sizes = docs.select(
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_words"),
        *kept,
    )
    placed = ranked(sizes, ["_source"], ["_words", "_id"])
    targets = source_targets(placed.select("_source", "_words"), weights, max_repeats)
    shift = offset(F.col("_source"), seed)
    upto = F.shiftright(F.col("_rank") * F.col("step") + shift, 24)
    before = F.shiftright((F.col("_rank") - 1) * F.col("step") + shift, 24)
    return (
        attach(placed, targets, ["_source"])
        .withColumn("copies", upto - before)
        .select(
            F.col("_id").alias("doc_id"),
            F.col("_words").alias("size"),
            "source_size",
            "target",
            "copies",
            *["_row" for _ in kept],
        )
    )


def mixed(docs, weights=WEIGHTS, max_repeats=3, seed="mix"):
    """The rows of ``docs``, each as many times as the mix takes it."""
    rows = planned(docs, weights, max_repeats, seed, F.struct("*"))
    rows = rows.where("copies > 0").select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    )
    return rows.select("_row.*")
