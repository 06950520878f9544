"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``k`` smallest distinct 48-bit hashes of a text's 5-word shingles (A-Z lowered; a
text of fewer words is one shingle). Sketches of parts merge into the sketch of their union, and
two sketches estimate resemblance, containment and the number of distinct shingles.

``with_next`` pairs every document with the next one in the order of descending ``doc_id`` without
a window over the whole table: documents are placed in blocks between quantiles of ``doc_id``,
a block also gets the first document of the block after it, and each block is read in order.

Defined results: null and empty texts have the empty sketch; two empty sketches have resemblance
1, an empty and another one 0; equal texts have equal sketches; a null doc_id comes last; rows of
the same doc_id are ordered by their text; in a table of one row the next document is itself;
other columns never matter.
"""

import base64
import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from runlens.llm.text import CHUNK, column_bytes, shingles

K = 128
WORDS = 5
_BITS = np.uint64(48)
_ROWS = 1 << 15


def sketches(column, k=K, words=WORDS):
    """The sketch of every row of a string column, as a list of sorted uint64 arrays."""
    buf, offs = column_bytes(column)
    out, row, n = [], 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + CHUNK, side="right")) - 1
        end = min(max(end, row + 1), row + _ROWS, n)
        own, hashes = shingles(buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row], words)
        keys = np.sort(own.astype(np.uint64) << _BITS | hashes >> np.uint64(16))
        if len(keys):
            keys = keys[np.append(True, keys[1:] != keys[:-1])]
        bounds = np.searchsorted(keys, np.arange(end - row + 1, dtype=np.uint64) << _BITS)
        keys &= (np.uint64(1) << _BITS) - np.uint64(1)
        out += [
            keys[a : min(b, a + k)]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        ]
        row = end
    return out


def merge(a, b, k=K):
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a, b, k=K):
    """The estimated share of common shingles among all of both."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = np.append(True, ~twice)
    size = min(k, int(distinct.sum()))
    limit = both[distinct][size - 1]
    return float((both[1:][twice] <= limit).sum()) / size


def distinct_count(a, k=K):
    """The estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**48)


def containment(a, b, k=K):
    """The estimated share of the first one's shingles that the second one has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    common = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return min(1.0, common / distinct_count(a, k))


def as_text(sketch):
    """A sketch as text: 8 characters for each hash, in order."""
    return base64.b64encode(
        sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    ).decode()


def from_text(text):
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs, k=K):
    """doc_id, fingerprint (text) and n_shingles (estimated) of each document."""

    def run(batches):
        for batch in batches:
            found = sketches(batch.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([as_text(s) for s in found], pa.string()),
                    pa.array([distinct_count(s, k) for s in found], pa.float64()),
                ],
                ["doc_id", "fingerprint", "n_shingles"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, fingerprint string, n_shingles double"
    )


def merged(prints, key, k=K, salts=64):
    """The fingerprint of each value of ``key`` (a string column) from those of its parts.

    Parts are merged where they lie, then by (key, salt), then by key, so that no task gets more
    than one sketch per key and task, or per key and salt.
    """

    def run(batches):
        found = {}
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                sketch = from_text(text or "")
                found[name] = merge(found[name], sketch, k) if name in found else sketch
            if len(found) > 100_000:
                yield rows(found)
                found = {}
        yield rows(found)

    def rows(found):
        names = list(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([as_text(found[x]) for x in names], pa.string())],
            [key, "fingerprint"],
        )

    schema = f"`{key}` string, fingerprint string"
    once = prints.select(F.col(key).cast("string").alias(key), "fingerprint").mapInArrow(run, schema)
    salt = F.pmod(F.xxhash64("fingerprint"), F.lit(salts))
    twice = once.repartition(key, salt).mapInArrow(run, schema)

    def last(batches):
        yield from run(pa.RecordBatch.from_arrays(b.columns[:2], [key, "fingerprint"]) for b in batches)

    # A task may give a key more than once if it holds very many keys, so the last step groups.
    return twice.groupBy(key).applyInArrow(
        lambda table: pa.Table.from_batches(list(last(table.to_batches()))), schema
    )


def _text_hash():
    """A hash of the text that a double can hold, as percentiles need, in the order of xxhash64."""
    return F.shiftright(F.xxhash64("text"), 12)


def _exact(docs, found):
    """Percentiles of doc_id, which are doubles inside, as doc_ids that occur."""
    if all(abs(x) < 1 << 53 for x in found):
        return found
    below = [F.max(F.when(F.col("doc_id") <= F.lit(x), F.col("doc_id"))) for x in set(found)]
    row = docs.agg(F.max("doc_id"), *below).first()
    known = dict(zip(set(found), row[1:], strict=True)) | {max(found): row[0]}
    return [known[x] for x in found if known[x] is not None]


def _starts(docs, blocks):
    """(doc_id, hash of the text or None) of each block's first document, in order.

    Blocks hold about as many rows each. Those that start at a doc_id take all its rows; a doc_id
    of more rows than a block, or none, is cut at hashes of its texts.
    """
    share = [1 - i / blocks for i in range(blocks)]
    accuracy = max(10_000, 10 * blocks)
    found, rows, known = docs.agg(
        F.percentile_approx("doc_id", share, accuracy), F.count(F.lit(1)), F.count("doc_id")
    ).first()
    found = _exact(docs, found or [])
    pieces = Counter(found)
    # Shares are of the rows with a doc_id; the others come last.
    none = -(-(rows - known) * blocks // rows) if rows else 0
    heavy = [x for x, n in pieces.items() if n > 1]
    cuts = {}
    if heavy or none > 1:
        of_heavy = F.col("doc_id").isin(heavy) if heavy else F.lit(False)
        if none > 1:
            of_heavy = of_heavy | F.col("doc_id").isNull()
        text, fine = _text_hash(), [1 - i / (8 * blocks) for i in range(8 * blocks)]
        cuts = {
            r[0]: [r[1], *r[2]]
            for r in docs.where(of_heavy)
            .groupBy("doc_id")
            .agg(F.max(text), F.percentile_approx(text, fine, 8 * accuracy))
            .collect()
        }
    out = []
    for key in [*sorted(pieces, reverse=True), *([None] if none else [])]:
        if key in cuts:
            first, *rest = cuts[key]
            parts = none if key is None else pieces[key]
            some = {rest[i * 8 * blocks // parts] for i in range(parts)}
            out += [(key, x) for x in sorted({first, *some}, reverse=True)]
        elif key is not None:
            out.append((key, None))
    return out


def _placed(docs, blocks):
    """(block, ahead, doc_id, text): each document in its block, block starts once more before."""
    starts = _starts(docs, blocks)
    last = max(len(starts) - 1, 0)
    # ``~`` turns falling numbers into rising ones.
    ids = [key for key, _ in starts if key is not None]
    down = ~np.array(sorted(set(ids), reverse=True), dtype=np.int64)
    end = np.cumsum([n for _, n in sorted(Counter(ids).items(), reverse=True)], dtype=np.int64) - 1
    cuts = {}  # the first block of a doc_id that is cut, and the hashes its blocks start at
    for block, (key, text) in enumerate(starts):
        if text is not None:
            cuts.setdefault(key, (block, []))[1].append(text)

    @F.pandas_udf("array<int>")
    def place(ids: pd.Series, none: pd.Series, hashes: pd.Series) -> pd.Series:
        known = ~none.to_numpy()
        value = ids.to_numpy().astype(np.int64)
        texts = ~hashes.to_numpy().astype(np.int64)
        block = np.full(len(value), last)
        first = np.zeros(len(value), dtype=bool)
        if len(down):
            at = np.searchsorted(down, ~value[known], side="right") - 1
            block[known] = end[at]
            first[known] = down[at] == ~value[known]
        elif None not in cuts:
            first = ~known
        for key, (low, of_blocks) in cuts.items():
            rows = np.flatnonzero(~known if key is None else known & (value == key))
            tops = ~np.array(of_blocks, dtype=np.int64)
            piece = np.searchsorted(tops, texts[rows], side="right") - 1
            block[rows] = low + piece
            first[rows] = tops[piece] == texts[rows]
        before = np.where(block > 0, block - 1, last)
        return pd.Series(
            [
                [b, p] if f else [b]
                for b, p, f in zip(block.tolist(), before.tolist(), first.tolist(), strict=True)
            ]
        )

    doc = F.col("doc_id").cast("long")
    places = place(F.coalesce(doc, F.lit(0)), doc.isNull(), _text_hash())
    return docs.select("doc_id", "text", F.posexplode(places).alias("ahead", "block"))


def with_next(docs, fn, schema, blocks=None):
    """Apply ``fn(ids, texts, next)`` to runs of documents in descending doc_id.

    ``texts`` has one more text than ``ids``: that of the document after the last. ``fn`` returns
    a record batch. Runs have about ``CHUNK`` bytes.
    """
    spark = docs.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed(docs.select("doc_id", "text"), blocks)
    ordered = placed.repartition(blocks, "block").sortWithinPartitions(
        "block",
        "ahead",
        F.col("doc_id").desc_nulls_last(),
        F.xxhash64("text").desc(),
        F.col("text").desc_nulls_last(),
    )

    def run(batches):
        block, ids, texts, size, done = None, [], [], 0, False
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            for doc, text, ahead, own in zip(*columns, strict=True):
                if own != block:
                    block, ids, texts, size, done = own, [], [], 0, False
                if done:
                    continue
                if ahead:  # the first of the next block
                    yield fn(ids, [*texts, text or ""])
                    done = True
                    continue
                if size >= CHUNK or len(ids) >= _ROWS:
                    yield fn(ids, [*texts, text or ""])
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(text or "")
                size += len(texts[-1])

    return ordered.select("doc_id", "text", "ahead", "block").mapInArrow(run, schema)


def compare_with_edited(docs, k=K, blocks=None):
    """Fingerprints of each text and of its edited text, and what they have in common.

    The edited text has its last ``n_chars // 2`` code points replaced by the first as many of the
    next document (or all that it has).
    """

    def run(ids, texts):
        own, after = texts[:-1], texts[1:]
        edited = []
        for text, following in zip(own, after, strict=True):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + following[:half])
        of_texts = sketches(pa.array(texts, pa.large_string()), k)
        of_edited = sketches(pa.array(edited, pa.large_string()), k)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([as_text(s) for s in of_texts[:-1]], pa.string()),
                pa.array([as_text(s) for s in of_edited], pa.string()),
                pa.array(
                    [resemblance(a, b, k) for a, b in zip(of_texts[:-1], of_edited, strict=True)],
                    pa.float64(),
                ),
                pa.array(
                    [resemblance(a, b, k) for a, b in zip(of_texts[:-1], of_texts[1:], strict=True)],
                    pa.float64(),
                ),
            ],
            names,
        )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    names += ["near_edited", "near_next"]
    return with_next(
        docs,
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
        blocks,
    )
