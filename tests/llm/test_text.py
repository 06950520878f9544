import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import text
from tests.llm.data import LOW, WORD

TEXTS = st.lists(
    st.text(alphabet=st.sampled_from("aAb é\t\n\x0b日😀\x1c\x85"), max_size=30), max_size=8
)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    buf, offs = text.column_bytes(pa.array(texts, pa.string()))
    starts, ends, first = text.words(buf, offs)
    data = buf.tobytes()
    found = [data[a:b].decode() for a, b in zip(starts, ends, strict=True)]
    assert [found[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [
        WORD.findall(t) for t in texts
    ]
    hashes = text.hasher(1).ranges(buf, starts, ends, fold=True)
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert (hashes[i] == hashes[j]) == (a.translate(LOW) == b.translate(LOW))
    assert text.char_counts(buf, offs).tolist() == [len(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    buf, offs = text.column_bytes(pa.array(texts, pa.string()))
    row, hashes = text.shingles(buf, offs, 3)
    by_hash = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t.translate(LOW))
        want = [tuple(w[j : j + 3]) for j in range(len(w) - 2)] or ([tuple(w)] if w else [])
        own = hashes[row == i].tolist()
        assert len(own) == len(want)
        for h, g in zip(own, want, strict=True):
            assert by_hash.setdefault(h, g) == g
    assert len(by_hash) == len(set(by_hash.values()))


def test_chunks_cover_all_rows_and_nulls():
    column = pa.chunked_array([pa.array(["ab", None, "c" * 50]), pa.array(["", "d"])])
    parts = list(text.chunks(column, 10))
    assert [p[0] for p in parts] == [0, 2, 3]
    assert b"".join(p[1].tobytes() for p in parts) == b"ab" + b"c" * 50 + b"d"
    assert list(text.chunks(pa.array([], pa.string()))) == []


def test_same_in_row():
    twice, again = text.same_in_row(np.array([0, 0, 1, 0]), np.array([5, 5, 5, 7], dtype=np.uint64))
    assert twice.tolist() == [True, True, False, False]
    assert again.tolist() == [False, True, False, False]


def test_a_long_text_leaves_no_table_behind():
    """What a hasher keeps is the same after a text of 20 MB, and so are the hashes."""

    def kept():
        tables = [t for h in text._HASHERS.values() for p in (h.powers, h.inverses) for t in (p.low, p.high)]
        return sum(t.nbytes for t in tables)

    word = np.frombuffer(b"abcdefg ", dtype=np.uint8)
    near = text.hasher(3).ranges(word, np.array([0]), np.array([7]))
    before = kept()
    long = np.tile(word, 20 << 17)
    starts = np.arange(0, len(long), 1 << 16) + 8
    starts = starts[starts + 7 <= len(long)]
    assert set(text.hasher(3).ranges(long, starts, starts + 7).tolist()) == set(near.tolist())
    assert kept() == before <= len(text._HASHERS) * (2 << 20)


def test_hashes_across_the_parts_of_a_table():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 100, 200_000, dtype=np.uint8)
    for at in (0, 65_530, 65_536, 131_070, 199_980):
        place = np.array([at])
        own = text.hasher(5).ranges(buf[at : at + 20].copy(), np.array([0]), np.array([20]))
        assert text.hasher(5).ranges(buf, place, place + 20)[0] == own[0]
        other = buf[at : at + 20].copy()
        other[7] ^= 1
        assert text.hasher(5).ranges(other, np.array([0]), np.array([20]))[0] != own[0]
