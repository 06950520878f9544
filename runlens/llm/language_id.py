"""Language identification by interpolated Kneser-Ney character models, one per language.

A text's words are its runs of letters, lower-cased; each letter and the end of each word is
predicted from the ``ORDER - 1`` symbols before it in the word. The counts of all training texts
are added over the cluster and stored, and each language's model is made from all of its n-grams, so
that continuation counts, totals and discounts are those of the whole input. A model is one sorted
array of n-gram hashes per order with the interpolated log probabilities, and one of context hashes
with the weights for unseen continuations: about 12 bytes for each n-gram and context, which grows
with the variety of a language's n-grams. The driver makes one model at a time.

The language of the lowest cross-entropy per symbol is predicted. ``score`` is its share of the
languages' likelihoods, each taken to the power of the inverse root of the text's length, since
symbols are not independent. A prediction is rejected (``accepted`` false) if its cross-entropy
lies further above the mean of all training texts of the language than a quarter more than the
``PERCENTILE`` of these do (and ``Z`` deviations at least, which allow for a text's length), or if
``score`` is below ``MIN_SCORE``, or if no limit of the language is known.

Defined results: a null text or one without a letter is ``und`` with score 0, rejected; equal
cross-entropies go to the language that sorts first; without training texts all are ``und``; rows
with a null lang or text teach nothing; repeated rows count as often as they occur.
"""

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from runlens.llm.text import U64, char_counts, chunks, column_bytes, lean, mix, sequence_hashes
from runlens.operators.facts import attach
from runlens.sources.store import settle

ORDER = 4
PERCENTILE = 0.99
Z = 10.0
MIN_SCORE = 0.5
_PAD = 0x20
_WINDOW = 1 << 20


@functools.cache
def _letters():
    """The lower case of each letter's code point, 0 for all else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _words(buf, offs):
    """Code points (0 between words), start and end of each word, words of each row (n + 1)."""
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    rows = np.append(0, np.cumsum(char_counts(buf, offs)))
    low = _letters()[points]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[rows] = True
    word = low > 0
    start = word & edge[:-1]
    start[1:] |= word[1:] & ~word[:-1]
    end = word & edge[1:]
    end[:-1] |= word[:-1] & ~word[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return low, starts, ends, np.searchsorted(starts, rows)


def _distinct(low, starts, ends, more=None):
    """Number of each word among the distinct ones, and one place of each of these."""
    keys = sequence_hashes(mix(low.astype(U64)), starts, ends)
    codes, distinct = pd.factorize(keys if more is None else mix(keys ^ more))
    place = np.empty(len(distinct), dtype=np.int64)
    place[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, place


def _padded(low, starts, ends, order):
    """Symbols of words with pads before and an end behind, and the places that are predicted."""
    sizes = ends - starts + order
    last = np.cumsum(sizes)
    total = int(last[-1]) if len(last) else 0
    symbols = np.full(total, _PAD, dtype=np.uint32)
    within = np.arange(total) - np.repeat(last - sizes, sizes)
    size = np.repeat(sizes, sizes)
    letters = (within >= order - 1) & (within < size - 1)
    symbols[letters] = low[np.repeat(starts, sizes)[letters] + within[letters] - (order - 1)]
    return symbols, np.flatnonzero(within >= order - 1), np.repeat(np.arange(len(sizes)), sizes)


def gram_hashes(symbols, at, order):
    """The hashes of the 1-, 2-, ... ``order``-grams that end at the places ``at``."""
    h = np.zeros(len(at), dtype=U64)
    out = []
    for n in range(order):
        h = mix(h * U64(0x9E3779B97F4A7C15) + symbols[at - n].astype(U64) + U64(1))
        out.append(h)
    return out


def gram_counts(docs, order=ORDER):
    """(lang, gram, n) over all rows of ``docs`` (lang, text)."""

    @lean
    def run(batches):
        found = {}

        def rows():
            texts = list(found)
            counts = [found[x] for x in texts]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _ in texts], pa.string()),
                    pa.array([gram for _, gram in texts], pa.string()),
                    pa.array(counts, pa.int64()),
                ],
                ["lang", "gram", "n"],
            )

        for batch in batches:
            langs, names = pd.factorize(np.array(batch.column(0).to_pylist(), dtype=object))
            for row, buf, offs in chunks(batch.column(1), _WINDOW):
                low, starts, ends, first = _words(buf, offs)
                if not len(starts):
                    continue
                lang = np.repeat(langs[row : row + len(offs) - 1], np.diff(first))
                codes, place = _distinct(low, starts, ends, mix(lang.astype(U64) + U64(1)))
                weight = np.bincount(codes)
                symbols, at, word = _padded(low, starts[place], ends[place], order)
                of = lang[place][word[at]]
                key = mix(gram_hashes(symbols, at, order)[-1] ^ mix(of.astype(U64) + U64(1)))
                number, distinct = pd.factorize(key)
                sums = np.bincount(number, weights=weight[word[at]]).astype(np.int64)
                sample = np.empty(len(distinct), dtype=np.int64)
                sample[number[::-1]] = np.arange(len(number))[::-1]
                grams = np.stack([symbols[at[sample] - n] for n in range(order - 1, -1, -1)], 1)
                text = np.ascontiguousarray(grams).tobytes().decode("utf-32-le")
                for i, (k, n) in enumerate(zip(of[sample].tolist(), sums.tolist(), strict=True)):
                    pair = (names[k], text[i * order : (i + 1) * order])
                    found[pair] = found.get(pair, 0) + n
            if len(found) > 500_000:
                yield rows()
                found = {}
        yield rows()

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(counts):
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class CharModel:
    """One language's interpolated Kneser-Ney model, in sorted hash arrays."""

    def __init__(self, grams, counts, order=ORDER):
        """``grams`` has a row of ``order`` code points for each n-gram."""
        self.order = order
        levels = {}  # order -> (grams, counts): below the top, in how many ways each is preceded
        levels[order] = (grams, counts.astype(np.int64))
        for n in range(order - 1, 0, -1):
            shorter = levels[n + 1][0][:, 1:]
            distinct, ways = np.unique(shorter, axis=0, return_counts=True)
            levels[n] = (distinct, ways)
        self.keys, self.logs, self.contexts, self.weights = {}, {}, {}, {}
        below_keys, below = None, None
        for n in range(1, order + 1):
            table, c = levels[n]
            flat = np.ascontiguousarray(table).reshape(-1)
            ends = np.arange(len(table)) * n + n - 1
            hashes = gram_hashes(flat, ends, n)
            d = _discount(c)
            if n == 1:
                context, number = np.zeros(1, dtype=U64), np.zeros(len(c), dtype=np.int64)
            else:
                own = gram_hashes(flat, ends - 1, n - 1)[-1]
                context, number = np.unique(own, return_inverse=True)
            total = np.bincount(number, weights=c)
            kinds = np.bincount(number)
            weight = d * kinds / total
            if n == 1:
                lower = np.full(len(c), 1.0 / (len(c) + 1))
                self.floor = float(np.log(weight[0] / (len(c) + 1)))
            else:
                lower = below[np.searchsorted(below_keys, hashes[n - 2])]
            p = np.maximum(c - d, 0) / total[number] + weight[number] * lower
            order_ = np.argsort(hashes[-1])
            below_keys, below = hashes[-1][order_], p[order_]
            self.keys[n], self.logs[n] = below_keys, np.log(below).astype(np.float32)
            self.contexts[n], self.weights[n] = context, np.log(weight).astype(np.float32)

    def log_probabilities(self, ending, before):
        """Of each place; ``ending[n]`` has the n-grams' hashes, ``before[n]`` the contexts'."""
        out = np.zeros(len(ending[1]), dtype=np.float64)
        open_ = np.arange(len(out))
        for n in range(self.order, 0, -1):
            own = ending[n][open_]
            at = np.searchsorted(self.keys[n], own)
            at[at == len(self.keys[n])] = 0
            hit = self.keys[n][at] == own
            out[open_[hit]] += self.logs[n][at[hit]]
            open_ = open_[~hit]
            if n == 1:
                out[open_] += self.floor
            elif len(open_):
                context = before[n - 1][open_]
                at = np.searchsorted(self.contexts[n], context)
                at[at == len(self.contexts[n])] = 0
                seen = self.contexts[n][at] == context
                out[open_[seen]] += self.weights[n][at[seen]]
        return out


class Identifier:
    """The models of all languages and the limits of their texts' cross-entropies."""

    def __init__(self, models):
        self.names = sorted(models)
        self.models = [models[x] for x in self.names]
        self.limits = {}  # language -> (mean, variance, deviations that are allowed)

    def entropies(self, buf, offs):
        """Symbols of each row, and the nats per symbol of each row under each language."""
        n = len(offs) - 1
        low, starts, ends, first = _words(buf, offs)
        if not len(starts) or not self.models:
            return np.zeros(n, dtype=np.int64), np.zeros((n, len(self.models)))
        codes, place = _distinct(low, starts, ends)
        order = self.models[0].order
        symbols, at, word = _padded(low, starts[place], ends[place], order)
        ending = dict(enumerate(gram_hashes(symbols, at, order), 1))
        before = dict(enumerate(gram_hashes(symbols, at - 1, order - 1), 1))
        bounds = np.searchsorted(word[at], np.arange(len(place)))
        sizes = np.append(0, np.cumsum(ends - starts + 1))
        count = sizes[first[1:]] - sizes[first[:-1]]
        out = np.zeros((n, len(self.models)))
        for k, model in enumerate(self.models):
            of_word = np.add.reduceat(model.log_probabilities(ending, before), bounds)
            sums = np.append(0.0, np.cumsum(of_word[codes]))
            out[:, k] = -(sums[first[1:]] - sums[first[:-1]]) / np.maximum(count, 1)
        return count, out

    def predict(self, buf, offs):
        """(language or None, score, entropy, accepted) of each row, as arrays."""
        count, entropy = self.entropies(buf, offs)
        n = len(count)
        if not self.models:
            return [None] * n, np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool)
        best = entropy.argmin(1)
        least = entropy[np.arange(n), best]
        odds = np.exp(-(entropy - least[:, None]) * np.sqrt(count)[:, None])
        score = np.where(count > 0, 1 / odds.sum(1), 0.0)
        known = [self.limits.get(x, (-np.inf, 0.0, Z)) for x in self.names]
        mean, variance, z = np.array(known)[best].T
        with np.errstate(divide="ignore"):
            limit = mean + z * np.sqrt(variance + 4.0 / count)
        accepted = (count > 0) & (least <= limit) & (score >= MIN_SCORE)
        names = [self.names[k] if c else None for k, c in zip(best.tolist(), count, strict=True)]
        return names, score, np.where(count > 0, least, 0.0), accepted


def _models(counts, order):
    """The model of each language from stored ``counts``, one language after the other."""
    models = {}
    names = [r.lang for r in counts.select("lang").distinct().collect()]
    for lang in sorted(names):
        own = counts.where(F.col("lang") == lang).select("gram", "n").toArrow()
        text = column_bytes(own["gram"])[0].tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        models[lang] = CharModel(points.reshape(-1, order), own["n"].to_numpy(), order)
    return models


def train(docs, order=ORDER):
    """The identifier of the languages in ``docs`` (doc_id, lang, text), counted on the cluster."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    tool = Identifier(_models(settle(gram_counts(rows, order), "grams", packed=True), order))
    calibrate(rows, tool)
    return tool


def calibrate(rows, tool):
    """Set the limits of ``tool`` from all ``rows`` (lang, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(tool)

    @lean
    def run(batches):
        for batch in batches:
            names = shared.value.names
            for row, buf, offs in chunks(batch.column(1), _WINDOW):
                count, entropy = shared.value.entropies(buf, offs)
                langs = batch.column(0).slice(row, len(count)).to_pylist()
                own = [
                    entropy[i, names.index(x)] if x in names and count[i] else None
                    for i, x in enumerate(langs)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(own, pa.float64()), pa.array(count)],
                    ["lang", "own", "n"],
                )

    own = rows.mapInArrow(run, "lang string, own double, n long").where("own is not null")
    own = settle(own, "calibration", packed=True)
    limits = own.groupBy("lang").agg(F.avg("own").alias("mean"), F.var_pop("own").alias("var"))
    spread = F.sqrt(F.col("var") + 4.0 / F.col("n"))
    z = (F.col("own") - F.col("mean")) / spread
    widest = attach(own, limits, ["lang"]).groupBy("lang", "mean", "var")
    for lang, mean, variance, most in widest.agg(
        F.percentile_approx(z, PERCENTILE, 10_000)
    ).collect():  # a row for each language that the model has
        tool.limits[lang] = (mean, variance, max(Z, 1.25 * most))


def identify(docs, tool, und="und"):
    """doc_id, lang_pred, score, entropy and accepted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(tool)

    @lean
    def run(batches):
        for batch in batches:
            for row, buf, offs in chunks(batch.column(1), _WINDOW):
                names, score, entropy, accepted = shared.value.predict(buf, offs)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(names)).cast(pa.int64()),
                        pa.array([x or und for x in names], pa.string()),
                        pa.array(score),
                        pa.array(entropy),
                        pa.array(accepted),
                    ],
                    ["doc_id", "lang_pred", "score", "entropy", "accepted"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, entropy double, accepted boolean"
    )


def accepted_rows(docs, tool):
    """``docs`` without the rows that the identifier rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(tool)

    @lean
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for row, buf, offs in chunks(batch.column(at), _WINDOW):
                keep = shared.value.predict(buf, offs)[3]
                yield batch.slice(row, len(keep)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id, folds, fold):
    """Whether crc32 of the doc_id as text falls into the fold that is held out."""
    text = F.col(doc_id).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % folds == fold, F.lit(False))
