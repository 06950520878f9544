"""Spelling variant grouping: words of the corpus that differ by one letter, found with bitsets.

**Words** are maximal runs of letters with A-Z lowered, counted over all texts. A planted fault
(``fault_every``) deletes one letter of a run where the contract asks for it.

**Index.** For a slice of the vocabulary and each (position, letter) a bitset tells which of its
words have that letter there. A query word is followed letter by letter, for all words of the slice
at once: ``same`` words agree so far, ``changed`` words have one letter replaced, ``longer`` words
have one letter more, so that they are looked up at the next position. Each step is a few word-
parallel operations on 64 words a machine word. After the last letter the sets are cut by the
words' lengths; a missing letter is the same link seen from the longer word.

**Slices.** Two words at distance one, the shorter of length l, share the first l // 2 letters or
the last l - l // 2. So each word is entered by its front and by its back, with the words of its own
length and of one letter less; what shares an entry meets in one bucket, and whatever else lies in
that bucket costs little. A link is counted by its front if that agrees (``same`` after l // 2
steps), else by its back, so exactly once. The number of buckets follows the vocabulary. An entry
shared by more than ``BUCKET`` words is split into a grid of slices, where each query slice meets
each index slice, so that no task holds more than about two slices.

**Forms.** A bucket gives each word's number of links and its best neighbour, not the links. A
word's form is its neighbour of largest count if that is ``ratio`` times its own; counts grow along
a chain of forms, so chains are short, and pointer doubling finds the root in five joins at most.

Defined results: a null text has no words; a null doc_id counts as an empty one; repeated rows count
as often as they occur; ties go to the word that sorts first by code points; an empty table gives no
rows; other columns never matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runlens.llm.text import lean
from runlens.operators.facts import attach
from runlens.sources.store import settle

LETTERS = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKET = 8192
_ROUNDS = 5  # 2**5 steps; a chain multiplies a 63-bit count by 5 in each step, so has 27 at most


def word_counts(docs, fault_every=199, min_length=6, min_count=5):
    """(word, n) of the corpus: runs of letters, A-Z lowered, each ``fault_every``-th with a fault.

    The fault depends on the document and the run alone: the run's crc32 with its document's id
    tells whether a letter goes and which.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(1))).alias("_run"),
    )
    plain = F.octet_length("_run") == F.length("_run")
    lowered = F.when(plain, F.lower("_run")).otherwise(F.translate("_run", UPPER, LOWER))
    runs = runs.select("_id", lowered.alias("_run"))
    code = F.crc32(F.concat("_id", F.lit(":"), "_run"))
    runs = runs.select("_run", code.alias("_code"))
    at = (F.col("_code") % F.length("_run")).cast("int")
    faulty = F.concat(
        F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run"))
    )
    word = F.when(F.col("_code") % fault_every == 0, faulty).otherwise(F.col("_run"))
    return (
        runs.select(word.alias("word"))
        .where(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
    )


def entries(vocabulary, bucket=BUCKET):
    """(slice, word, n, back, short, query, indexed): entries placed in slices of bounded size.

    ``short`` is the length of the shorter word of the links looked for; ``back`` tells whether the
    entry is by the word's end, ``query`` whether the row is looked up, ``indexed`` whether it is
    found.
    """
    length = F.length("word")
    kinds = F.array(
        *[
            F.struct(F.lit(back).alias("back"), (length - less).alias("short"))
            for back in (False, True)
            for less in (0, 1)
        ]
    )
    rows = vocabulary.select("word", "n", F.explode(kinds).alias("_kind")).select(
        "word", "n", "_kind.*"
    )
    half = F.floor(F.col("short") / 2).cast("int")
    rest = F.col("short") - half
    part = F.when(
        F.col("back"), F.substring(F.col("word"), length - rest + 1, rest)
    ).otherwise(F.substring(F.col("word"), F.lit(1), half))
    rows = rows.withColumn("_entry", F.xxhash64("back", "short", part))
    heavy = (
        rows.groupBy("_entry")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > bucket)
        .select("_entry", F.ceil(F.col("_rows") / bucket).cast("int").alias("_sides"))
    )
    size = settle(rows.agg((F.count(F.lit(1)) / bucket + 1).cast("long").alias("_buckets")), "size")
    rows = attach(rows, heavy, ["_entry"], "left")
    rows = attach(rows, size, [], stored=True)
    own = F.pmod(F.xxhash64(F.lit("side"), "word"), F.col("_sides")).cast("int")
    sides = F.sequence(F.lit(0), F.col("_sides") - 1)
    is_query = length == F.col("short")
    # A cell of the grid is (side of the index, side of the queries).
    def cell(i, q, query):
        return F.struct(i.alias("i"), q.alias("q"), query.alias("query"))

    as_index = F.transform(sides, lambda s: cell(own, s, F.lit(False)))
    as_query = F.transform(sides, lambda s: cell(s, own, F.lit(True)))
    one = cell(F.lit(-1), F.lit(-1), is_query)
    cells = (
        F.when(F.col("_sides").isNull(), F.array(one))
        .when(is_query, F.concat(as_index, as_query))
        .otherwise(as_index)
    )
    placed = rows.withColumn("_cell", F.explode(cells))
    light = F.pmod("_entry", "_buckets")
    slice_ = F.when(F.col("_sides").isNull(), light).otherwise(
        F.xxhash64("_entry", "_cell.i", "_cell.q")
    )
    split = F.col("_sides").isNotNull()
    return placed.select(
        slice_.alias("slice"), "word", "n", "back", "short",
        F.col("_cell.query").alias("query"), (~split | ~F.col("_cell.query")).alias("indexed"),
    )


def _letters(words):
    """The code points of words, one row each, 0 beyond their end."""
    wide = np.array(words, dtype=np.str_)
    size = wide.dtype.itemsize // 4
    return wide.view(np.uint32).reshape(len(words), size)


class _Index:
    """The (position, letter) bitsets of a slice of the vocabulary, made one position at a time."""

    def __init__(self, letters):
        self.letters = letters
        self.lanes = -(-len(letters) // 64)

    def pack(self, rows):
        """Rows of booleans over the words as rows of machine words."""
        room = np.zeros((len(rows), self.lanes * 64), dtype=bool)
        room[:, : rows.shape[1]] = rows
        return np.packbits(room, axis=1, bitorder="little").view(np.uint64)

    def at(self, position):
        """The distinct letters of a position and their bitsets."""
        if position >= self.letters.shape[1]:
            return np.zeros(0, dtype=np.uint32), np.zeros((0, self.lanes), dtype=np.uint64)
        column = self.letters[:, position]
        found = np.unique(column)
        found = found[found > 0]
        return found, self.pack(found[:, None] == column[None, :])


def _having(table, wanted):
    """The bitset of each wanted letter; empty for a letter that no word has there."""
    letters, bits = table
    if not len(letters):
        return np.zeros((len(wanted), bits.shape[1]), dtype=np.uint64)
    place = np.minimum(np.searchsorted(letters, wanted), len(letters) - 1)
    out = bits[place]
    out[letters[place] != wanted] = 0
    return out


def links(queries, words, length, back, chunk=1 << 20):
    """(query, word) numbers of the links of ``queries``, all of ``length``, to ``words``.

    ``words`` have that length or one letter more. Only links whose first ``length // 2`` letters
    agree are given, or with ``back`` only the others.
    """
    index = _Index(_letters(words))
    asked = _letters(queries)
    sizes = np.count_nonzero(index.letters, axis=1)
    equal, more = index.pack((sizes == length)[None, :]), index.pack((sizes == length + 1)[None, :])
    step = max(1, chunk // index.lanes)
    out = []
    for low in range(0, len(asked), step):
        some = asked[low : low + step]
        same = np.full((len(some), index.lanes), ~np.uint64(0))
        changed, longer = np.zeros_like(same), np.zeros_like(same)
        front, here = None, index.at(0)
        for i in range(length):
            if i == length // 2:
                front = same
            ahead = index.at(i + 1)
            agree, shifted = _having(here, some[:, i]), _having(ahead, some[:, i])
            longer = (longer | same) & shifted
            changed = (changed & agree) | (same & ~agree)
            same = same & agree
            here = ahead
        front = same if front is None else front
        found = (changed & equal) | ((longer | same) & more)
        found &= ~front if back else front
        row, lane = np.nonzero(found)
        bits = np.unpackbits(found[row, lane].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        out.append(np.stack([row[k] + low, lane[k] * 64 + bit]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)


def _best(words, counts):
    """The place of each word in the order of falling count, then code points."""
    order = np.lexsort((np.array(words, dtype=np.str_), -counts))
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    return place, order


def _group_links(table):
    """(low, high, change) row numbers in ``table``: each link from its query to the other word."""
    back = table.column("back").to_numpy(zero_copy_only=False)
    short = table.column("short").to_numpy()
    query = table.column("query").to_numpy(zero_copy_only=False)
    indexed = table.column("indexed").to_numpy(zero_copy_only=False)
    words = table.column("word").to_pylist()
    order = np.lexsort((short, back))
    cut = np.flatnonzero((np.diff(short[order]) != 0) | (np.diff(back[order].astype(int)) != 0)) + 1
    for rows in np.split(order, cut):
        asked, kept = rows[query[rows]], rows[indexed[rows]]
        if not len(asked) or not len(kept):
            continue
        found = links(
            [words[i] for i in asked], [words[i] for i in kept],
            int(short[rows[0]]), bool(back[rows[0]]),
        )
        yield asked[found[0]], kept[found[1]]


def _summaries(table):
    """One row per word with links: their number and the best neighbour."""
    words = table.column("word").to_pylist()
    counts = table.column("n").to_numpy()
    if not words:
        return [], [], [], []
    # A word has several rows in a slice; number the words.
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    number = np.array([distinct[w] for w in words])
    names = list(distinct)
    n = np.zeros(len(names), dtype=np.int64)
    n[number] = counts
    place, order = _best(names, n)
    near = np.zeros(len(names), dtype=np.int64)
    best = np.full(len(names), len(names), dtype=np.int64)
    size = np.array([len(w) for w in names])
    for a, b in _group_links(table):
        a, b = number[a], number[b]
        # Words of one length are queries of each other; a longer word learns of its link here.
        far = size[a] != size[b]
        to, other = np.concatenate([a, b[far]]), np.concatenate([b, a[far]])
        near += np.bincount(to, minlength=len(names))
        np.minimum.at(best, to, place[other])
    hit = np.flatnonzero(near)
    top = order[best[hit]]
    return [names[i] for i in hit], near[hit], [names[i] for i in top], n[top]


def _in_slices(vocabulary, run, schema, bucket):
    return entries(vocabulary, bucket).groupBy("slice").applyInArrow(run, schema)


def near_counts(vocabulary, bucket=BUCKET):
    """(word, n_near, best, best_n) of each word with a link; ``vocabulary`` has word and n."""

    def run(table):
        word, near, best, n = _summaries(table)
        return pa.table(
            {
                "word": pa.array(word, pa.string()),
                "near": pa.array(near, pa.int64()),
                "best": pa.array(best, pa.string()),
                "best_n": pa.array(n, pa.int64()),
            }
        )

    parts = _in_slices(vocabulary, run, "word string, near long, best string, best_n long", bucket)
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (
        parts.groupBy("word")
        .agg(F.sum("near").alias("n_near"), top.alias("_top"))
        .select(
            "word",
            "n_near",
            F.col("_top.best").alias("best"),
            (-F.col("_top.less")).alias("best_n"),
        )
    )


def near_pairs(vocabulary, bucket=BUCKET):
    """The links themselves: (word, other), each once, the shorter or smaller word first."""

    def run(table):
        words = table.column("word").to_pylist()
        left, right = [], []
        for a, b in _group_links(table):
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = words[i], words[j]
                if len(x) < len(y) or x < y:
                    left.append(x)
                    right.append(y)
        return pa.table({"word": pa.array(left, pa.string()), "other": pa.array(right, pa.string())})

    return _in_slices(vocabulary, run, "word string, other string", bucket)


def _roots(chain):
    """(word, root): the last word reached from each word along its forms, by pointer doubling."""
    at = settle(chain.select("word", F.col("form").alias("root")), "roots", packed=True)
    for _ in range(_ROUNDS):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        moved = settle(
            attach(at, ahead, ["root"], "left").select(
                "word",
                F.coalesce("_ahead", "root").alias("root"),
                F.col("_ahead").isNotNull().alias("_moved"),
            ),
            "roots",
            packed=True,
        )
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return at


def variants(vocabulary, ratio=5, bucket=BUCKET):
    """word, form, root, n, n_near and form_n of each word of a ``vocabulary`` (word, n).

    A word's form is its most frequent neighbour, if that is ``ratio`` times as frequent.
    """
    vocabulary = settle(vocabulary.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_counts(vocabulary, bucket)
    has_form = F.col("best_n") >= ratio * F.col("n")
    joined = attach(vocabulary, near, ["word"], "left")
    formed = settle(
        joined.select(
            "word",
            F.when(has_form, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "forms",
        packed=True,
    )
    roots = _roots(formed.where(F.col("form").isNotNull()))
    return attach(formed, roots, ["word"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs, ratio=5, **options):
    """``variants`` of the words of ``docs``; ``options`` are those of ``word_counts``."""
    return variants(word_counts(docs, **options), ratio)
