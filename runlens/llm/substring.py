"""Substring dedup by difference-cover anchors.

Every repeat of ``window`` words is found. Words are hashed only at the positions p of a text with
``p mod v`` in a difference cover D: for any two positions there is a shift below v that takes
both into D, so two equal windows share an anchor, a run of ``window - v + 1`` words at the same
place in both. An anchor that occurs twice is extended: the full windows that contain it are
hashed (96 bits) and their first occurrence, by (doc_id, start), is looked up.

Texts are first packed into stored units of about ``UNIT`` bytes. A unit sends each distinct
anchor and each distinct window once, to the bucket of its hash; buckets answer units. So what a
bucket gets of one hash is bounded by the units, not by the documents that share it. Buckets are
as many as ``spark.sql.shuffle.partitions``.

Defined results: a null or empty text has no words; a text shorter than the window is kept; rows
of one doc_id are separate documents, none of them earlier; a null doc_id comes after all others;
other columns never matter.
"""

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from runlens.llm.text import U64, column_bytes, hasher, lean, rows_of, sequence_hashes, windows, words
from runlens.sources.store import settle

WINDOW = 20
UNIT = 2 << 20
#: Perfect difference sets: each difference modulo the key is one of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
_LAST = np.iinfo(np.int64).max


@functools.cache
def _zstd():
    return pa.Codec("zstd", 3)


def cover_for(window):
    """The largest period whose anchors keep at least about a third of the window."""
    period = max(v for v in COVERS if v == 1 or 3 * v <= 2 * window)
    return period, COVERS[period]


def pack(ids, texts):
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])
    options = pa.ipc.IpcWriteOptions(compression=_zstd())
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def unpack(data):
    """(doc_id column, bytes, offsets) of a unit."""
    with pa.ipc.open_stream(data) as reader:
        batch = reader.read_next_batch()
    return (batch.column(0), *column_bytes(batch.column(1)))


def units(docs):
    """(unit, pack): stored runs of documents."""

    @lean
    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1)
            _, offs = column_bytes(texts)
            row, n = 0, len(offs) - 1
            while row < n:
                end = int(np.searchsorted(offs, offs[row] + UNIT, side="right")) - 1
                end = min(max(end, row + 1), n)
                own = pack(
                    batch.column(0).slice(row, end - row).cast(pa.int64()),
                    texts.slice(row, end - row).cast(pa.large_string()),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([own.to_pybytes()], pa.binary())],
                    ["unit", "pack"],
                )
                number, row = number + 1, end

    rows = docs.select("doc_id", "text").mapInArrow(run, "unit long, pack binary")
    return settle(rows, "units", packed=True)


class Unit:
    """A unit's words, anchors and windows."""

    def __init__(self, data, window):
        self.window = window
        self.ids, self.buf, self.offs = unpack(data)
        self.order = self.ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.starts, self.ends, self.first = words(self.buf, self.offs)
        self.hashes = hasher(1).ranges(self.buf, self.starts, self.ends)
        self.row = rows_of(self.first)
        self.stop = self.first[1:][self.row]  # where the row of each word ends

    def anchors(self, buckets):
        """Word index and key of each anchor: its bucket and 32 bits of its hash."""
        period, cover = cover_for(self.window)
        length = self.window - period + 1
        whole = windows(self.hashes, length)
        at = np.arange(len(whole))
        place = (at - self.first[:-1][self.row[: len(whole)]]) % period
        stop = self.stop[: len(whole)]
        long = stop - self.first[:-1][self.row[: len(whole)]] >= self.window
        at = at[np.isin(place, cover) & (at + length <= stop) & long]
        h = whole[at]
        return at, (h >> U64(32)) % U64(buckets) << U64(32) | h & U64(0xFFFFFFFF)

    def candidates(self, buckets, shared):
        """Start and two hashes of the windows that contain an anchor that occurs twice."""
        at, keys = self.anchors(buckets)
        period, _ = cover_for(self.window)
        found, counts = np.unique(keys, return_counts=True)
        hit = np.isin(keys, np.concatenate([found[counts > 1], shared]))
        at = at[hit]
        cover = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        np.add.at(cover, np.maximum(at - period + 1, self.first[:-1][self.row[at]]), 1)
        np.add.at(cover, at + 1, -1)
        index = np.arange(len(self.hashes))
        start = index[(np.cumsum(cover[:-1]) > 0) & (index + self.window <= self.stop)]
        one = sequence_hashes(self.hashes, start, start + self.window, 5)
        two = sequence_hashes(self.hashes, start, start + self.window, 9) >> U64(32)
        return start, one, two.astype(np.uint32)

    def repeats(self, start, one, two):
        """The distinct windows with their least doc_id, and where a window occurs a second time.

        Returns (hash, hash, least doc_id) of the distinct windows, the number of each start's
        window, and whether an earlier occurrence lies in the unit.
        """
        order = np.lexsort((start, two, one))
        one, two = one[order], two[order]
        row = self.row[start[order]]
        doc = self.order[row]
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        number = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(doc, at) if len(at) else doc
        earlier = doc > least[number]
        # Starts are in order, so a row's own repeats follow each other.
        earlier[1:] |= ~new[1:] & (row[1:] == row[:-1])
        numbers, before = np.empty_like(number), np.empty_like(earlier)
        numbers[order], before[order] = number, earlier
        return one[at], two[at], least, numbers, before


def _keys(parts):
    return np.concatenate([np.frombuffer(p, dtype=U64) for p in parts] or [np.zeros(0, U64)])


_WINDOW_KEY = np.dtype([("one", "<u8"), ("two", "<u4")])


def _sent(buckets, numbers, unit, columns):
    """One row for each bucket; ``columns`` are arrays sorted by ``numbers``."""
    bounds = np.searchsorted(numbers, np.arange(buckets + 1))
    rows = [(b, a, e) for b, (a, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if e > a]
    return [
        pa.array([b for b, _, _ in rows], pa.int32()),
        pa.array([unit] * len(rows), pa.int64()),
        *[pa.array([enc(c[a:e]) for _, a, e in rows], pa.binary()) for c, enc in columns],
    ]


def _raw(values):
    return values.tobytes()


def _dense(values):
    return _zstd().compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def _sizes(column, width):
    return np.array([len(v) // width for v in column], dtype=np.int64)


def shared_anchors(stored, buckets, window=WINDOW):
    """(unit, keys): the anchors of each unit that other units have as well."""

    @lean
    def send(batches):
        for batch in batches:
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, keys = Unit(data.as_buffer(), window).anchors(buckets)
                keys = np.unique(keys)
                tags = (keys & U64(0xFFFFFFFF)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    _sent(buckets, keys >> U64(32), unit, [(tags, _raw)]), ["bucket", "unit", "tags"]
                )

    def answer(table):
        parts = table.column("tags").to_pylist()
        owner = np.repeat(np.arange(len(parts)), _sizes(parts, 4))
        tags = np.concatenate([np.frombuffer(p, dtype=np.uint32) for p in parts])
        order = np.argsort(tags, kind="stable")
        s = tags[order]
        twice = np.zeros(len(s), dtype=bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= twice[1:]
        hit = np.sort(order[twice])
        bucket = U64(table.column("bucket")[0].as_py())
        keys = bucket << U64(32) | tags[hit].astype(U64)
        bounds = np.searchsorted(owner[hit], np.arange(len(parts) + 1))
        return pa.table(
            {
                "unit": table.column("unit"),
                "keys": pa.array(
                    [keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                    pa.binary(),
                ),
            }
        )

    return (
        stored.mapInArrow(send, "bucket int, unit long, tags binary")
        .groupBy("bucket")
        .applyInArrow(answer, "unit long, keys binary")
        .where("length(keys) > 0")
        .groupBy("unit")
        .agg(F.collect_list("keys").alias("keys"))
    )


def earlier_windows(stored, shared, buckets, window=WINDOW):
    """(unit, earlier): the windows of each unit that occur under a smaller doc_id elsewhere."""

    @lean
    def send(batches):
        for batch in batches:
            for unit, data, keys in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True
            ):
                own = Unit(data.as_buffer(), window)
                one, two, least, _, _ = own.repeats(*own.candidates(buckets, _keys(keys or [])))
                bucket = (one >> U64(40)) % U64(buckets)
                order = np.lexsort((least, bucket))
                columns = [(one[order], _raw), (two[order], _raw), (least[order], _dense)]
                yield pa.RecordBatch.from_arrays(
                    _sent(buckets, bucket[order], unit, columns),
                    ["bucket", "unit", "one", "two", "least"],
                )

    def answer(table):
        parts = table.column("one").to_pylist()
        sizes = _sizes(parts, 8)
        owner = np.repeat(np.arange(len(parts)), sizes)
        one = np.concatenate([np.frombuffer(p, dtype=U64) for p in parts])
        two = np.concatenate(
            [np.frombuffer(p, dtype=np.uint32) for p in table.column("two").to_pylist()]
        )
        least = np.concatenate(
            [
                np.frombuffer(_zstd().decompress(p, int(n) * 8, asbytes=True), dtype=np.int64)
                for p, n in zip(table.column("least").to_pylist(), sizes, strict=True)
            ]
        )
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = np.sort(order[smallest < least[order]])
        keys = np.empty(len(hit), dtype=_WINDOW_KEY)
        keys["one"], keys["two"] = one[hit], two[hit]
        bounds = np.searchsorted(owner[hit], np.arange(len(parts) + 1))
        return pa.table(
            {
                "unit": table.column("unit"),
                "earlier": pa.array(
                    [keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                    pa.binary(),
                ),
            }
        )

    return (
        stored.join(shared, "unit", "left")
        .select("unit", "pack", "keys")
        .mapInArrow(
            send, "bucket int, unit long, one binary, two binary, least binary"
        )
        .groupBy("bucket")
        .applyInArrow(answer, "unit long, earlier binary")
        .where("length(earlier) > 0")
        .groupBy("unit")
        .agg(F.collect_list("earlier").alias("earlier"))
    )


def _removed(own, keys, earlier, buckets):
    """Whether each word of the unit is covered by a window that starts earlier elsewhere.

    Each of ``earlier`` is one of the unit's own distinct windows, so the search below finds it.
    """
    start, one, two = own.candidates(buckets, keys)
    a, b, _, number, before = own.repeats(start, one, two)
    at = np.searchsorted(a, earlier["one"])
    while (late := b[at] != earlier["two"]).any():  # the next one of the same first hash
        at[late] += 1
    known = np.zeros(len(a), dtype=bool)
    known[at] = True
    start = start[before | known[number]]
    cover = np.zeros(len(own.hashes) + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + own.window, -1)
    return np.cumsum(cover[:-1]) > 0


def _kept_texts(own, removed):
    """The kept words of each row, joined by one space."""
    kept = ~removed
    starts, sizes = own.starts[kept], own.ends[kept] - own.starts[kept] + 1
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    buf = np.append(own.buf, np.uint8(0x20))
    out = buf[np.arange(total) + np.repeat(starts - ends + sizes, sizes)]
    out[ends - 1] = 0x20
    done = np.append(0, ends)[np.append(0, np.cumsum(kept))[own.first]]
    data = out.tobytes()
    return [data[a : max(a, b - 1)] for a, b in zip(done[:-1].tolist(), done[1:].tolist(), strict=True)]


def deduplicated(docs, window=WINDOW, digest=False):
    """doc_id, n_words, n_removed and the kept words, as ``text`` or as its hash ``kept_sha256``."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = units(docs)
    shared = settle(shared_anchors(stored, buckets, window), "anchors", packed=True)
    earlier = earlier_windows(stored, shared, buckets, window)
    name = "kept_sha256" if digest else "text"

    @lean
    def run(batches):
        for batch in batches:
            for data, keys, found in zip(
                batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
            ):
                own = Unit(data.as_buffer(), window)
                before = np.frombuffer(b"".join(found or []), dtype=_WINDOW_KEY)
                removed = _removed(own, _keys(keys or []), before, buckets)
                counts = np.append(0, np.cumsum(removed))[own.first]
                texts = _kept_texts(own, removed)
                if digest:
                    texts = [hashlib.sha256(t).hexdigest() for t in texts]
                else:
                    texts = [t.decode("utf-8") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        own.ids,
                        pa.array(np.diff(own.first)),
                        pa.array(np.diff(counts)),
                        pa.array(texts, pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", name],
                )

    return (
        stored.join(shared, "unit", "left")
        .join(earlier, "unit", "left")
        .select("unit", "pack", "keys", "earlier")
        .mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")
    )
