"""Line dedup: lines that many documents share stay in one of them.

Lines (cut at ``\\n``) are exploded with their positions, normalised (white space ``[\\x20\\x09-\\x0D]``
stripped at both ends, A-Z lowered) and hashed to 128 bits. For each hash of a key of at least
``min_chars`` code points the distinct documents are counted; from ``min_docs`` documents on the key
loses its lines everywhere but in the largest ``doc_id`` that holds it. Texts are put together
again from the runs of positions between the dropped ones, in one pass over a text's lines.

Counts are distinct by (key, document) before they meet by key, so a line of a third of all
documents sends one row per task to its key. Keys to drop are stored, and their real size decides
whether lines move to be looked up; adaptive execution splits the join at heavy keys. A row is told
apart by (doc_id, 128-bit hash of its text), which needs no numbering of rows and is the same after
a retry; rows that agree in both have the same result. A document's dropped positions are gathered
as a set, no larger than its text.

Defined results: a null or empty text is one empty line, a null text stays null; rows of one doc_id
are one document, and so are all rows without one, which sorts before all others; equal rows get
equal results; an empty table gives no rows; other columns never matter.
"""

from functools import reduce

from pyspark.sql import functions as F

from runlens.operators.facts import attach
from runlens.sources.store import settle

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 5
MIN_CHARS = 40
_ROW = ["doc_id", "_t1", "_t2"]
_KEY = ["_h1", "_h2"]


def normalised(line):
    """The key of a line. ``lower`` is used where it cannot touch more than A-Z, for speed."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(col, names):
    """Two independent 64-bit hashes."""
    return [F.xxhash64(col).alias(names[0]), F.xxhash64(F.lit("second"), col).alias(names[1])]


def keyed_lines(docs, min_chars=MIN_CHARS):
    """doc_id, hash of the text, position and key hash of each line whose key is long enough."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *_hashes(text, _ROW[1:]),
        F.posexplode(F.split(text, "\n")).alias("_pos", "_line"),
    ).where(F.octet_length("_line") >= min_chars)
    keys = lines.select(*_ROW, "_pos", normalised(F.col("_line")).alias("_key"))
    return keys.where(F.length("_key") >= min_chars).select(
        *_ROW, "_pos", *_hashes(F.col("_key"), _KEY)
    )


def shared_keys(keyed, min_docs=MIN_DOCS):
    """The key hashes found in at least ``min_docs`` documents, with the document that keeps them."""
    without_id = F.max(F.col("doc_id").isNull().cast("long"))
    n_docs = F.count_distinct("doc_id") + without_id
    return (
        keyed.groupBy(*_KEY)
        .agg(n_docs.alias("_docs"), F.max("doc_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
        .select(*_KEY, "_keeper")
    )


def _kept_runs(positions):
    """The runs (``at``, ``n``) of lines between sorted dropped positions; the last has no end."""
    starts = F.concat(F.array(F.lit(0)), F.transform(positions, lambda p: p + 1))
    ends = F.concat(positions, F.array(F.lit(2**31 - 1)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n")))


def dropped_lines(docs, min_docs=MIN_DOCS, min_chars=MIN_CHARS):
    """One row per (doc_id, text) that loses lines: how many, and the runs of lines that stay."""
    keyed = settle(keyed_lines(docs, min_chars), "line_keys", packed=True)
    found = attach(keyed, shared_keys(keyed, min_docs), _KEY)
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    positions = F.sort_array(F.collect_set("_pos"))
    return (
        lost.groupBy(*_ROW)
        .agg(positions.alias("_gone"))
        .select(*_ROW, F.size("_gone").alias("_n_gone"), _kept_runs(F.col("_gone")).alias("_runs"))
    )


def deduplicated(docs, min_docs=MIN_DOCS, min_chars=MIN_CHARS, digest=False):
    """doc_id, text without its dropped lines, n_lines before dropping and n_dropped.

    ``digest`` gives the hash of the kept text (``kept_sha256``) in its place.
    """
    gone = settle(dropped_lines(docs, min_docs, min_chars), "lost_lines")
    text = F.coalesce("text", F.lit(""))
    # Split before the join: the lines are then a column, not computed again for each run.
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *_hashes(text, _ROW[1:]),
        F.split(text, "\n").alias("_lines"),
        F.col("text").isNull().alias("_no_text"),
    )
    marked = {name: f"_{name}" for name in _ROW}
    same = reduce(
        lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(mark)) for name, mark in marked.items()]
    )
    rows = split.join(gone.withColumnsRenamed(marked), same, "left")
    runs = F.transform("_runs", lambda r: F.slice("_lines", r["at"] + 1, r["n"]))
    lines = F.when(F.col("_runs").isNull(), F.col("_lines")).otherwise(F.flatten(runs))
    kept = F.array_join(lines, "\n")
    if digest:
        kept = F.sha2(kept.cast("binary"), 256).alias("kept_sha256")
    else:
        kept = F.when(~F.col("_no_text"), kept).alias("text")
    return rows.select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("_n_gone", F.lit(0)).cast("long").alias("n_dropped"),
        kept,
    )
