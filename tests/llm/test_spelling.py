import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runlens.llm import spelling
from tests.llm.data import LOW, documents, edge_rows


def plain_counts(rows, min_length=6, min_count=5):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            code = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if code % 199 == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts, ratio=5):
    near = defaultdict(set)
    for a in counts:
        for b in counts:
            if one_apart(a, b):
                near[a].add(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x))
        if counts[best] >= ratio * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


def vocabulary(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def mutated(rng, word):
    at, how = rng.randrange(len(word) + 1), rng.randrange(3)
    letter = rng.choice("abcéÿ×")
    return word[:at] + letter * (how > 0) + word[at + (how < 2) :]


def random_words(seed, n, heads=("inter", "abc", "")):
    rng, words = random.Random(seed), set()
    while len(words) < n:
        w = rng.choice(heads) + "".join(rng.choice("abcéÿ×") for _ in range(rng.randint(6, 12)))
        words.add(w)
        for _ in range(rng.randrange(4)):
            w = mutated(rng, w)
            words.add(w)
    return {w: rng.choice([5, 6, 7, 40, 300, 5000, 10**12]) for w in sorted(words)}


@pytest.mark.parametrize("bucket", [8192, 40, 3])
def test_links_and_forms(spark, bucket):
    counts = random_words(bucket, 500)
    found = spelling.variants(vocabulary(spark, counts), bucket=bucket).collect()
    assert len(found) == len(counts)
    assert set(map(tuple, found)) == plain(counts)


def test_pairs(spark):
    counts = random_words(5, 300)
    found = spelling.near_pairs(vocabulary(spark, counts), bucket=50).collect()
    want = {
        frozenset((a, b)) for a in counts for b in counts if one_apart(a, b)
    }
    assert len(found) == len(want) and {frozenset(p) for p in found} == want


@pytest.mark.parametrize("length", [1, 2, 7, 64, 200])
def test_bitsets_against_all_pairs(length):
    rng = random.Random(length)
    base = "".join(rng.choice("ab") for _ in range(length))
    words = {base}
    while len(words) < 90 and len(words) < 2**length:
        w = mutated(rng, rng.choice(sorted(words)))
        if len(w) in (length, length + 1):
            words.add(w)
    words = sorted(words)
    asked = [w for w in words if len(w) == length]
    found = set()
    for back in (False, True):
        pairs = spelling.links(asked, words, length, back, chunk=7).T.tolist()
        assert len(set(map(tuple, pairs))) == len(pairs)
        for a, b in pairs:
            head = length // 2
            assert (asked[a][:head] != words[b][:head]) is back
            found.add((asked[a], words[b]))
    assert found == {(a, b) for a in asked for b in words if one_apart(a, b)}


def test_chain_of_forms(spark):
    counts, word = {}, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"
    for k in range(20):  # each one letter from the next and five times as frequent
        counts["b" * k + word[k:]] = 5 ** (k + 1)
    found = {r["word"]: r["root"] for r in spelling.variants(vocabulary(spark, counts)).collect()}
    assert set(found.values()) == {"b" * 19 + word[19:]}


def test_counts_of_texts(spark):
    words = " ".join(["Kästchen", "kastchen", "ÄPFEL÷ab", "x", "naïveté", "Ordinary"] * 30)
    rows = edge_rows() + [(i, words + "\n" + words.upper(), "de", "a") for i in range(100, 400)]
    rows += [(7, "a" * 50_000 + " " + "b" * 50_001, "en", "a")] * 6
    want = plain_counts(rows)
    docs = documents(spark, rows)
    assert dict(map(tuple, spelling.word_counts(docs).collect())) == want
    found = spelling.spelling_variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, found.collect())) == plain(want)


def test_empty(spark):
    assert spelling.spelling_variants(documents(spark, [])).collect() == []
    assert spelling.spelling_variants(documents(spark, [(1, None, None, None)])).collect() == []


def test_heavy_entry_is_split(spark):
    """Words of one front and length: no slice holds more than about two buckets."""
    counts = {"abcdef" + "".join(p): 5 for p in np.random.default_rng(0).choice(list("ghijkl"), (900, 6))}
    slices = spelling.entries(vocabulary(spark, counts), bucket=100).groupBy("slice").count()
    assert max(r["count"] for r in slices.collect()) < 500
