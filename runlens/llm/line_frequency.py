"""Quality rules: base counts of each text, and lines that too many documents of a host repeat.

A line (cut at ``\\n``) is normalised to its words with A-Z lowered, and hashed. For each host
(column ``source``) the documents that have the line are counted, equal texts once. A line is
removed if more than ``max(min_docs, share * documents of the host)`` have it; a document that
keeps less than ``min_left`` of its words is rejected.

Counts are combined before each shuffle and first taken by (host, line, text), so that neither a
heavy host nor a group of copies meets in one task; the table of frequent lines is stored, and its
real size decides whether the join that looks lines up moves the documents' lines.

Defined results: a null or empty text has no lines and fails the base rule; lines without a word
count for nothing; the null host is a host; repeated rows get the same verdict; other columns
never matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runlens.llm.text import (
    _SEPARATOR,
    char_counts,
    chunks,
    hasher,
    row_sums,
    rows_of,
    same_in_row,
    sequence_hashes,
    windows,
    word_hashes,
    words,
)
from runlens.operators.facts import attach
from runlens.sources.store import settle

WINDOW = 5
_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1


def _columns(buf, offs):
    """The base counts, the text's hash and the lines of all rows."""
    n = len(offs) - 1
    hashes, first = word_hashes(buf, offs)
    row = rows_of(first)
    counts = np.diff(first)
    blanks = row_sums(_SEPARATOR[buf], offs)

    whole = windows(hashes, WINDOW)
    inside = np.flatnonzero(np.arange(len(whole)) + WINDOW <= first[1:][row[: len(whole)]])
    twice, _ = same_in_row(row[inside], whole[inside])
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, inside[twice], 1)
    np.add.at(cover, inside[twice] + WINDOW, -1)
    repeated = row_sums(np.cumsum(cover[:-1]) > 0, first)

    breaks = np.flatnonzero(buf == 0x0A)
    line_start = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    line_start = line_start[line_start < len(buf)]
    # A line ends at its break or where the row ends.
    line_row = np.searchsorted(offs, line_start, side="right") - 1
    after = np.append(line_start[1:], len(buf))
    line_end = after - (buf[after - 1] == 0x0A)
    starts, ends, _ = words(buf, offs)
    low = np.searchsorted(starts, line_start)
    high = np.searchsorted(starts, line_end)
    real = high > low
    line_row, low, high = line_row[real], low[real], high[real]
    raw = hasher(2).ranges(buf, line_start[real], line_end[real])
    _, again = same_in_row(line_row, raw)
    duplicates = np.bincount(line_row[again], minlength=n)
    folded = hasher(4).ranges(buf, starts, ends, fold=True)
    normal = sequence_hashes(folded, low, high)
    text = hasher(6).ranges(buf, offs[:-1], offs[1:])
    at = np.searchsorted(line_row, np.arange(n + 1)).astype(np.int32)

    def lists(values, kind):
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(kind)))

    return [
        pa.array(counts.astype(np.int64)),
        pa.array(char_counts(buf, offs) - blanks),
        pa.array(row_sums(_SYMBOLS[buf], offs)),
        pa.array(duplicates.astype(np.int64)),
        pa.array(repeated),
        pa.array(text.view(np.int64)),
        lists(normal.view(np.int64), np.int64),
        lists(high - low, np.int32),
    ]


_NAMES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "text_hash",
    "lines",
    "line_words",
]


def base_counts(docs, host="source"):
    """doc_id, host, the base counts, text_hash, and hash and words of each line with a word."""

    def run(batches):
        for batch in batches:
            for row, buf, offs in chunks(batch.column(1)):
                own = batch.slice(row, len(offs) - 1)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).cast(pa.int64()), own.column(2), *_columns(buf, offs)],
                    ["doc_id", "host", *_NAMES],
                )

    return docs.select("doc_id", "text", F.col(host).cast("string").alias("host")).mapInArrow(
        run,
        "doc_id long, host string, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, text_hash long, lines array<long>, "
        "line_words array<int>",
    )


def frequent_lines(counted, min_docs=10, share=0.01):
    """(host, line, n_docs) of the lines that more documents of their host have than allowed."""
    texts = counted.groupBy("host", "text_hash").agg(F.any_value("lines").alias("lines"))
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    per_line = (
        texts.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") > min_docs)
    )
    return (
        attach(per_line, hosts, ["host"])
        .where(F.col("n_docs") > F.col("host_docs") * share)
        .select("host", "line", "n_docs")
    )


def verdicts(docs, host="source", min_docs=10, share=0.01, min_left=0.3):
    """One row per document: the base counts, base_failed, left_words and kept."""
    counted = settle(
        base_counts(docs, host).withColumn("uid", F.monotonically_increasing_id()),
        "lines",
        packed=True,
    )
    frequent = frequent_lines(counted, min_docs, share)
    each = counted.select(
        "uid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")
    ).select("uid", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("n"))
    removed = (
        attach(each, frequent, ["host", "line"])
        .groupBy("uid")
        .agg(F.sum("n").alias("removed"))
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return counted.join(removed, "uid", "left").select(
        "doc_id",
        *_NAMES[:5],
        failed.alias("base_failed"),
        left.alias("left_words"),
        (~failed & (left >= F.col("n_words") * min_left)).alias("kept"),
    )


def cleaned(docs, host="source", min_docs=10, share=0.01):
    """doc_id and text without its frequent lines; a null text stays null."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))),
    )
    stored = settle(
        docs.select("doc_id", "text", F.col(host).cast("string").alias("host")).withColumns(
            {
                "uid": F.monotonically_increasing_id(),
                "text_hash": F.xxhash64("text"),
                "all_lines": lines,
            }
        ),
        "texts",
        packed=True,
    )
    blank = F.xxhash64(F.lit(""))
    counted = stored.select(
        "host", "text_hash", F.array_remove("all_lines", blank).alias("lines")
    )
    frequent = frequent_lines(counted, min_docs, share)
    each = stored.select("uid", "host", F.explode(F.array_distinct("all_lines")).alias("line"))
    gone = attach(each, frequent, ["host", "line"]).groupBy("uid").agg(
        F.collect_set("line").alias("gone")
    )
    kept = F.filter(
        F.arrays_zip(F.split("text", "\n").alias("t"), F.col("all_lines").alias("h")),
        lambda x: ~F.array_contains("gone", x["h"]),
    )
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda x: x["t"]), "\n")
    )
    return stored.join(gone, "uid", "left").select("doc_id", text.alias("text"))
