"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes numbers about its words, lines, characters and repeats. A number falls into one
of at most ``BINS`` bins of equal share. The model adds one table value per feature, and one per
chosen pair of features in coarser bins; the tables are learnt by cyclic boosting: each round
fits, for one feature after another, a tree of at most four leaves to the gradient of the log
loss and adds a part of it to the feature's table. The pairs of the largest remaining gain follow
in the same way. Scoring looks up bins and adds table values for all rows of a chunk at once.

The model is fitted on the driver from the features of at most ``SAMPLE`` labelled documents, those
of the smallest hash of doc_id; scoring reads every document.

Defined results: null and empty texts have all features 0 and get the score of these; without
labels each score is 0.5; a null label teaches nothing; repeated rows have the same score; other
columns never matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runlens.llm.text import (
    char_counts,
    chunks,
    hasher,
    row_sums,
    rows_of,
    same_in_row,
    windows,
    words,
)

SAMPLE = 20_000
BINS = 32
COARSE = 8
PAIRS = 6
NAMES = [
    "log_words",
    "word_length",
    "word_length_sd",
    "short_words",
    "capital_words",
    "upper",
    "digits",
    "symbols",
    "punctuation",
    "wide",
    "bars",
    "bangs",
    "mentions",
    "distinct_words",
    "same_as_before",
    "repeated_windows",
    "words_a_line",
    "repeated_lines",
    "full_lines",
    "long_words",
]


def _flags(chars):
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER, _DIGIT = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("0123456789")
_SYMBOL, _PUNCT = _flags("#*$%&|<>"), _flags(".,;:!?")
_BAR, _BANG, _AT, _STOP = _flags("|"), _flags("!"), _flags("@"), _flags(".!?")


def features(buf, offs):
    """One row of features for each text."""
    n = len(offs) - 1
    starts, ends, first = words(buf, offs)
    hashes = hasher(1).ranges(buf, starts, ends)
    row, count = rows_of(first), np.diff(first)
    points = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    length = points[ends] - points[starts]
    sums = lambda values: row_sums(values, first)
    per_word = lambda values: sums(values) / np.maximum(count, 1)
    chars = np.maximum(char_counts(buf, offs), 1)
    share = lambda table: row_sums(table[buf], offs) / chars

    mean = per_word(length)
    deviation = np.sqrt(np.maximum(per_word(length**2) - mean**2, 0))
    upper = np.append(0, np.cumsum(_UPPER[buf]))
    capital = (upper[ends] - upper[starts]) * 2 > length
    _, seen = same_in_row(row, hashes)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    five = windows(hashes, 5)
    inside = np.flatnonzero(np.arange(len(five)) + 5 <= first[1:][row[: len(five)]])
    _, again = same_in_row(row[inside], five[inside])
    repeated = np.bincount(row[inside[again]], minlength=n)

    breaks = np.flatnonzero(buf == 0x0A)
    line = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    line = line[line < len(buf)]
    low, high = np.searchsorted(starts, line), np.searchsorted(starts, np.append(line[1:], len(buf)))
    low, high = low[high > low], high[high > low]
    line_row = row[low]
    lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    _, old = same_in_row(line_row, hasher(2).ranges(buf, starts[low], ends[high - 1]))
    full = _STOP[buf[ends[high - 1] - 1]]
    return np.stack(
        [
            np.log1p(count),
            mean,
            deviation,
            per_word(length <= 3),
            per_word(capital),
            share(_UPPER),
            share(_DIGIT),
            share(_SYMBOL),
            share(_PUNCT),
            1 - np.minimum(row_sums(buf < 0x80, offs) / chars, 1),
            row_sums(_BAR[buf], offs) / np.maximum(count, 1),
            row_sums(_BANG[buf], offs) / np.maximum(count, 1),
            row_sums(_AT[buf], offs) / np.maximum(count, 1),
            per_word(~seen),
            per_word(same),
            repeated / np.maximum(count, 1),
            np.log1p(count / lines),
            np.bincount(line_row[old], minlength=n) / lines,
            np.bincount(line_row[full], minlength=n) / lines,
            per_word(length >= 16),
        ],
        1,
    )


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _shallow_tree(g, h, leaves=4):
    """Values per bin of the best tree over ordered bins, grown leaf by leaf."""
    parts = [(0, len(g))]
    sg, sh = np.append(0.0, np.cumsum(g)), np.append(0.0, np.cumsum(h))
    while len(parts) < leaves:
        best = (1e-6, None, None)
        for lo, hi in parts:
            if hi - lo < 2:
                continue
            cut = np.arange(lo + 1, hi)
            left_g, left_h = sg[cut] - sg[lo], sh[cut] - sh[lo]
            right_g, right_h = sg[hi] - sg[cut], sh[hi] - sh[cut]
            gains = _gain(left_g, left_h) + _gain(right_g, right_h)
            gains -= _gain(sg[hi] - sg[lo], sh[hi] - sh[lo])
            at = int(gains.argmax())
            if gains[at] > best[0]:
                best = (gains[at], (lo, hi), int(cut[at]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.empty(len(g))
    for lo, hi in parts:
        out[lo:hi] = _leaf(sg[hi] - sg[lo], sh[hi] - sh[lo])
    return out


def _quadrants(g, h):
    """Values per cell of the best tree that cuts both axes once, and its gain."""
    sg, sh = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n, m = g.shape
    a_g, a_h = sg[:-1, :-1], sh[:-1, :-1]
    rows_g, rows_h = sg[:-1, -1:], sh[:-1, -1:]
    columns_g, columns_h = sg[-1:, :-1], sh[-1:, :-1]
    all_g, all_h = sg[-1, -1], sh[-1, -1]
    parts = [
        (a_g, a_h),
        (rows_g - a_g, rows_h - a_h),
        (columns_g - a_g, columns_h - a_h),
        (all_g - rows_g - columns_g + a_g, all_h - rows_h - columns_h + a_h),
    ]
    gains = sum(_gain(*p) for p in parts)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    values = [_leaf(x[i, j], y[i, j]) for x, y in parts]
    out = np.empty((n, m))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = values[0], values[1]
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values[2], values[3]
    return out, float(gains[i, j]) - _gain(all_g, all_h)


class AdditiveModel:
    """Tables per feature and per pair; ``fit`` learns them, ``score`` adds them."""

    def __init__(self):
        self.base, self.cuts, self.coarse, self.tables, self.pairs = 0.0, [], [], [], []

    @staticmethod
    def _bin(x, cuts):
        return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1)

    def fit(self, x, y, rounds=150, rate=0.1, pairs=PAIRS):
        if not len(y):
            return self
        quantiles = lambda bins: [
            np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) for c in x.T
        ]
        self.cuts, self.coarse = quantiles(BINS), quantiles(COARSE)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        bins = self._bin(x, self.cuts)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        total = np.full(len(y), self.base)
        for _ in range(rounds):
            for i, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-total))
                own = bins[:, i]
                g = np.bincount(own, y - p, len(table))
                h = np.bincount(own, p * (1 - p), len(table))
                step = rate * _shallow_tree(g, h)
                table += step
                total += step[own]
        coarse = self._bin(x, self.coarse)
        sizes = [len(c) + 1 for c in self.coarse]

        def cells(i, j, values):
            flat = np.bincount(coarse[:, i] * sizes[j] + coarse[:, j], values, sizes[i] * sizes[j])
            return flat.reshape(sizes[i], sizes[j])

        p = 1 / (1 + np.exp(-total))
        found = []
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes)):
                if sizes[i] > 1 and sizes[j] > 1:
                    gain = _quadrants(cells(i, j, y - p), cells(i, j, p * (1 - p)))[1]
                    found.append((-gain, i, j))
        chosen = sorted(found)[:pairs]
        self.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in chosen]
        for _ in range(rounds // 3):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-total))
                step, _ = _quadrants(cells(i, j, y - p), cells(i, j, p * (1 - p)))
                table += rate * step
                total += rate * step[coarse[:, i], coarse[:, j]]
        return self

    def score(self, x):
        total = np.full(len(x), self.base)
        if self.tables:
            bins, coarse = self._bin(x, self.cuts), self._bin(x, self.coarse)
            for i, table in enumerate(self.tables):
                total += table[bins[:, i]]
            for i, j, table in self.pairs:
                total += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-total))


def feature_rows(docs):
    """doc_id and its features (array of double) of each document."""

    def run(batches):
        for batch in batches:
            for row, buf, offs in chunks(batch.column(1)):
                x = features(buf, offs)
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(x)).cast(pa.int64()),
                        pa.ListArray.from_arrays(at, pa.array(x.reshape(-1))),
                    ],
                    ["doc_id", "x"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def train(docs, labels, label="quality", sample=SAMPLE):
    """The model of ``labels`` (doc_id and a label of 0 or 1), from at most ``sample`` of them."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample is bounded by its parameter, 16 bytes a row.
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")
    rows = (
        feature_rows(chosen)
        .groupBy("doc_id")
        .agg(F.max("x").alias("x"))
        .join(F.broadcast(drawn), "doc_id")
        .orderBy("doc_id")
        .select("x", "y")
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(NAMES))
    return AdditiveModel().fit(x, rows["y"].to_numpy(dtype=float))


def scored(docs, model):
    """doc_id and score of each document."""

    def run(batches):
        for batch in batches:
            for row, buf, offs in chunks(batch.column(1)):
                score = model.score(features(buf, offs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(score)).cast(pa.int64()), pa.array(score)],
                    ["doc_id", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
