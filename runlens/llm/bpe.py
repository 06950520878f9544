"""Byte-level BPE by corpus-level merge replay.

The texts of a window (2 MB, or one longer text) are cut into pieces by ``PATTERN``; each
distinct piece is encoded once. A piece that is a token is that token. All others lie in one array
of symbols, linked to their neighbours, with an inverted index from the rank of a token pair to the
positions where it occurs. Ranks are replayed from the lowest to the highest: a merge rewrites all
its positions at once and looks up only the pairs with a changed neighbour. A text's ids are those
of its pieces in order.

Merging all places of a rank at once equals the usual piece-by-piece order in vocabularies whose
tokens are each reachable by their own merges, since no merge can then give rise to a pair of a
lower rank; the driver checks this for the vocabulary it is given (``Encoder.unreachable``).

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are
encoded alike; special tokens are ordinary text; other columns never matter.
"""

import base64
import functools
import hashlib
import heapq
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa

from runlens.llm.text import chunks, hasher, lean, parts

# Fixed values of the vocabularies of this kind: the pattern that cuts texts into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 2 << 20
_SPACE, _BLANK, _LETTER, _NUMBER, _OTHER = range(5)
_CLASSES = []


def _classes():
    """The class of each code point."""
    if not _CLASSES:
        import regex

        table = np.full(0x110000, _OTHER, dtype=np.uint8)
        for low in range(0, 0x110000, 4096):
            if 0xD800 <= low < 0xE000:
                continue
            block = "".join(map(chr, range(low, low + 4096)))
            for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _BLANK)):
                for m in regex.finditer(pattern, block):
                    table[low + m.start() : low + m.end()] = kind
        table[0x20] = _SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def split(buf, offs):
    """Byte starts of the pieces of all rows, and the index of each row's first piece (n + 1)."""
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offs), dtype=np.int64)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(width, out=at[1:])
    row_starts = np.searchsorted(at, offs)
    edge = np.zeros(n + 1, dtype=bool)
    edge[row_starts] = True
    edge[n] = True
    kinds = _classes()[points]
    group = np.maximum(kinds, _BLANK)
    new = edge[:n].copy()
    new[0] = True
    new[1:] |= group[1:] != group[:-1]
    # The last blank before other text stands alone, or leads it if it is a space.
    first = np.flatnonzero(new[1:] & ~edge[1:n] & (group[:-1] == _BLANK)) + 1
    flags = new.copy()
    flags[first - 1] = True
    flags[first[points[first - 1] == 0x20]] = False
    quote = np.flatnonzero((points == 0x27) & flags & new)
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        closed = np.concatenate([edge, np.ones(3, bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32)) & ~closed[quote + 1]
        two = np.zeros(len(quote), dtype=bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        two &= ~closed[quote + 1] & ~closed[quote + 2]
        hit = one | two
        flags[quote[hit] + 1] = False
        after = quote[hit] + np.where(two[hit], 3, 2)
        flags[after[after < n]] = True
    starts = np.flatnonzero(flags)
    return at[starts], np.searchsorted(starts, row_starts)


def _gather(starts, lengths):
    """Indices of the ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


class Encoder:
    """The ranks of a ``.tiktoken`` file, ready to encode and decode."""

    def __init__(self, data):
        lines = (line.split() for line in data.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = array("q"), array("q"), array("i")
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        left, right = np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)
        merged = np.frombuffer(merged, np.int32)
        self.by_left = self._index(left << 32 | right, merged)
        self.by_right = self._index(right << 32 | left, merged)

    def unreachable(self):
        """The tokens that their own merges do not lead to."""
        tokens = list(self.ranks)
        _, counts = self._replay(tokens)
        return [t for t, n in zip(tokens, counts.tolist(), strict=True) if n != 1]

    @staticmethod
    def _index(keys, merged):
        order = np.argsort(keys)
        return keys[order], merged[order]

    @staticmethod
    def _rank(index, keys):
        """The rank of each pair, -1 if it is none."""
        known, merged = index
        if not len(known):
            return np.full(len(keys), -1)
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return np.where(known[at] == keys, merged[at], -1)

    def _replay(self, pieces):
        """Ids of ``pieces`` one after another, and how many each has."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(raw)
        sym = self.bytes[raw].astype(np.int64)
        last = np.cumsum(sizes) - 1
        # One slot past the end takes the writes of symbols without a neighbour.
        following = np.arange(1, n + 2)
        before = np.arange(-1, n)
        following[last] = n
        before[last + 1] = n
        before[0] = n
        sym = np.append(sym, -1)
        alive = np.ones(n + 1, dtype=bool)
        rank = np.full(n + 1, -1, dtype=np.int32)
        inner = np.flatnonzero(following[:n] < n)
        rank[inner] = self._rank(self.by_left, sym[inner] << 32 | sym[inner + 1])
        places = {}

        def add(ranks, positions):
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for r, a, b in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
                if r in places:
                    places[r].append(positions[a:b])
                else:
                    places[r] = [positions[a:b]]
                    heapq.heappush(heap, r)

        heap = []
        known = np.flatnonzero(rank >= 0)
        if len(known):
            add(rank[known], known)
        while heap:
            r = heapq.heappop(heap)
            lists = places.pop(r)
            p = np.unique(np.concatenate(lists))
            p = p[rank[p] == r]
            if not len(p):
                continue
            q = following[p]
            chained = p[1:] == q[:-1]
            if chained.any():  # of overlapping places take the first, third, ...
                head = np.flatnonzero(np.concatenate([[True], ~chained]))
                place = np.arange(len(p)) - np.repeat(head, np.diff(np.append(head, len(p))))
                p, q = p[place % 2 == 0], q[place % 2 == 0]
            z = following[q]
            sym[p] = r
            alive[q] = False
            rank[q] = -1
            following[p] = z
            before[z] = p
            o = before[p]
            right = np.where(z < n, self._rank(self.by_left, r << 32 | sym[z]), -1)
            left = np.where(o < n, self._rank(self.by_right, r << 32 | sym[o]), -1)
            rank[o] = left
            rank[p] = right
            rank[n] = -1
            ranks, spots = np.concatenate([right, left]), np.concatenate([p, o])
            real = ranks >= 0
            if real.any():
                add(ranks[real], spots[real])
        alive[n] = False
        counts = np.add.reduceat(alive[:n].astype(np.int64), last - sizes + 1) if n else sizes
        return sym[alive], counts

    def encode(self, buf, offs):
        """Ids of all rows (uint32) and the n + 1 offsets of the rows."""
        starts, hashes, firsts, done = [], [], [np.zeros(1, dtype=np.int64)], 0
        for row, part, own in parts(buf, offs, 1 << 19):
            at, first = split(part, own)
            ends = np.append(at[1:], len(part)) if len(at) else at
            hashes.append(hasher(3).ranges(part, at, ends))
            starts.append(at + offs[row])
            firsts.append(first[1:] + done)
            done += len(at)
        starts, first = np.concatenate(starts or [offs[:0]]), np.concatenate(firsts)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offs), dtype=np.int64)
        codes, distinct = pd.factorize(np.concatenate(hashes))
        sample = np.empty(len(distinct), dtype=np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]
        ends = np.append(starts[1:], len(buf))
        data = buf.tobytes()
        pieces = [
            data[a:b]
            for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)
        ]
        ranks = self.ranks
        own = np.fromiter((ranks.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        rest = np.flatnonzero(own < 0)
        ids, counts = self._replay([pieces[i] for i in rest.tolist()])
        lengths = np.ones(len(pieces), dtype=np.int64)
        lengths[rest] = counts
        at = np.empty(len(pieces), dtype=np.int64)
        at[rest] = np.cumsum(counts) - counts
        hits = np.flatnonzero(own >= 0)
        at[hits] = len(ids) + np.arange(len(hits))
        pool = np.concatenate([ids, own[hits]]).astype(np.uint32)
        sizes = lengths[codes]
        ends = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=ends[1:])
        return pool[_gather(at[codes], sizes)], ends[first]

    def decode(self, ids):
        """The bytes of ``ids``."""
        lengths = self.lengths[ids]
        return self.blob[_gather(self.starts[ids], lengths)]


_ENCODERS = {}


def encoder(data):
    """The encoder of a rank file's bytes, built once per worker."""
    key = hashlib.sha256(data).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


@functools.cache
def _ranks_of(path):
    """The bytes of a rank file of the driver, about a megabyte; tasks get them with their code."""
    with open(path, "rb") as f:
        data = f.read()
    if Encoder(data).unreachable():
        raise ValueError("the vocabulary has tokens that its own merges do not reach")
    return data


def encoded(docs, path):
    """doc_id, n_tokens and ``ids`` (array of int) of each text."""
    data = _ranks_of(path)

    @lean
    def run(batches):
        for batch in batches:
            for row, buf, offs in chunks(batch.column(1), WINDOW):
                ids, at = encoder(data).encode(buf, offs)
                lists = pa.ListArray.from_arrays(
                    pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))
                )
                own = batch.column(0).slice(row, len(at) - 1).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.diff(at)), lists], ["doc_id", "n_tokens", "ids"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decoded(tokens, path):
    """doc_id and ``data`` (the bytes) of rows of doc_id and ids; null ids give no bytes."""
    data = _ranks_of(path)

    @lean
    def run(batches):
        for batch in batches:
            out = [
                encoder(data).decode(np.array(ids or [], dtype=np.int64)).tobytes()
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], ["doc_id", "data"]
            )

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digest(docs, path):
    """doc_id, n_tokens, hash of the ids, and hash of what they decode to."""
    data = _ranks_of(path)

    @lean
    def run(batches):
        for batch in batches:
            for row, buf, offs in chunks(batch.column(1), WINDOW):
                tool = encoder(data)
                ids, at = tool.encode(buf, offs)
                of_ids, of_bytes = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = ids[a:b]
                    of_ids.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    of_bytes.append(hashlib.sha256(tool.decode(own).tobytes()).hexdigest())
                own = batch.column(0).slice(row, len(at) - 1).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.diff(at)), pa.array(of_ids), pa.array(of_bytes)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
