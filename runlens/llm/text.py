"""Words, windows and hashes of whole texts, computed for many rows at once inside a task.

Words are the runs of ``[^\\x20\\x09-\\x0D]``. All separators are single ASCII bytes, so words are
found in the UTF-8 bytes of an Arrow column without decoding them. Texts are taken in chunks of
about ``CHUNK`` bytes, which bounds memory (about 60 bytes per byte of the chunk); a text longer
than a chunk is a chunk of its own and is never cut.
"""

import ctypes
import functools

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h):
    """A bijection of 64-bit numbers that spreads every bit of its argument."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_HELD = 32 << 20  # bytes of input after which freed memory is given back


def _give_back():
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(run):
    """``run`` (batches to batches) that gives freed memory back now and then and at its end.

    Python workers live on from stage to stage, and what one stage freed would else stay theirs;
    idle ones keep it for as long as others of their executor are busy.
    """

    def one_by_one(batches):
        seen = 0
        for batch in batches:
            seen += batch.nbytes
            yield batch
            del batch
            if seen > _HELD:
                _give_back()
                seen = 0

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(one_by_one(batches))
        _give_back()

    return wrapped


_STEP = 1 << 16  # places that one part of a table of powers spans


class _Powers:
    """The powers of an odd number at any place below 2**32, from two small tables."""

    def __init__(self, base):
        self.low = self._table(base)
        self.high = self._table(pow(base, _STEP, 1 << 64))

    @staticmethod
    def _table(base):
        out = np.ones(_STEP, dtype=U64)
        out[1:] = U64(base)
        return np.multiply.accumulate(out)

    def at(self, places):
        return self.high[places >> 16] * self.low[places & (_STEP - 1)]

    def scale(self, values):
        """Multiply ``values`` in place by the powers of their places."""
        for start in range(0, len(values), _STEP):
            part = values[start : start + _STEP]
            part *= self.low[: len(part)]
            if start:
                part *= self.high[start >> 16]
        return values


class _Hasher:
    """A polynomial hash of byte ranges; all ranges of a buffer cost one running sum.

    What it keeps has the same size whatever the texts.
    """

    def __init__(self, seed):
        self.base = int(mix(np.array([seed], dtype=U64))[0]) | 1
        self.values = mix(np.arange(1, 257, dtype=U64) * U64(self.base))
        self.folded = self.values[_LOWER]
        self.powers, self.inverses = _Powers(self.base), _Powers(pow(self.base, -1, 1 << 64))

    def of_runs(self, values, starts, ends):
        """The hash of each run ``values[start:end]``; ``values`` are overwritten."""
        sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(self.powers.scale(values), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * self.inverses.at(starts)
        return mix(raw + (ends - starts).astype(U64))

    def ranges(self, buf, starts, ends, fold=False):
        """The hash of each ``buf[start:end]``, with A-Z lowered if ``fold``."""
        return self.of_runs((self.folded if fold else self.values)[buf], starts, ends)


_HASHERS = {}


def hasher(seed=1):
    if seed not in _HASHERS:
        _HASHERS[seed] = _Hasher(seed)
    return _HASHERS[seed]


def column_bytes(column):
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(column, limit=CHUNK):
    """Yield (first row, bytes, offsets) for runs of rows of at most ``limit`` bytes or one row."""
    yield from parts(*column_bytes(column), limit)


def parts(buf, offs, limit=CHUNK):
    """``chunks`` of a column's bytes and offsets."""
    n, row = len(offs) - 1, 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(buf, offs):
    """Start and end of each word, and for each row the index of its first word (n + 1 of them)."""
    separator = _SEPARATOR[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    before = edge[:-1].copy()
    before[1:] |= separator[:-1]
    after = edge[1:].copy()
    after[:-1] |= separator[1:]
    starts = np.flatnonzero(before & ~separator)
    ends = np.flatnonzero(after & ~separator) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf, offs, fold=False, seed=1):
    """A hash per word and for each row the index of its first word (n + 1 of them)."""
    starts, ends, first = words(buf, offs)
    return hasher(seed).ranges(buf, starts, ends, fold), first


def windows(hashes, k, seed=1):
    """The hash of every k consecutive hashes, whichever row they lie in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    by = U64(int(mix(np.array([seed + 77], dtype=U64))[0]) | 1)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= by
        out += hashes[j : j + n]
    return mix(out)


def rows_of(first):
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(buf, offs, k, fold=True, seed=1):
    """(row, hash) of every k-word shingle; a shorter row has all its words as its one shingle.

    Rows without a word have none. Shingles that repeat in a row are given each time.
    """
    hashes, first = word_hashes(buf, offs, fold, seed)
    counts = np.diff(first)
    row = rows_of(first)
    whole = windows(hashes, k, seed)
    inside = np.arange(len(whole)) + k <= first[1:][row[: len(whole)]]
    short = np.flatnonzero((counts > 0) & (counts < k))
    out_row, out_hash = row[: len(whole)][inside], whole[inside]
    if len(short):
        own = np.empty(len(short), dtype=U64)
        for n in range(1, k):
            of_n = np.flatnonzero(counts[short] == n)
            if len(of_n):
                at = first[short[of_n]]
                h = np.full(len(of_n), n, dtype=U64)
                for j in range(n):
                    h = mix(h * U64(0x9E3779B97F4A7C15) + hashes[at + j])
                own[of_n] = h
        out_row, out_hash = np.concatenate([out_row, short]), np.concatenate([out_hash, own])
    return out_row, out_hash


def distinct(row, hashes):
    """Sorted distinct (row, hash) pairs; ``row`` must lie below 2**31."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[keep], hashes[keep]


def char_counts(buf, offs):
    """Code points of each row."""
    starts = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=starts[1:])
    return np.diff(starts[offs])


def run_lists(row, n):
    """Offsets (n + 1) of the runs of the sorted ``row``."""
    return np.searchsorted(row, np.arange(n + 1))


def sequence_hashes(hashes, starts, ends, seed=5):
    """The hash of each run ``hashes[start:end]``, by one running sum."""
    return hasher(seed).of_runs(hashes.copy(), starts, ends)


def row_sums(values, offs):
    """The sum of ``values`` in each row."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[offs])


def same_in_row(row, hashes):
    """Whether each (row, hash) pair occurs at least twice, and whether it occurred before."""
    key = mix(hashes ^ mix(row.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    again = np.zeros(len(s), dtype=bool)
    again[1:] = s[1:] == s[:-1]
    twice = again.copy()
    twice[:-1] |= again[1:]
    out_twice, out_again = np.empty_like(twice), np.empty_like(again)
    out_twice[order], out_again[order] = twice, again
    return out_twice, out_again
