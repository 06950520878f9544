import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from runlens.llm import ngram_join, substring
from runlens.llm.queries import QUERIES
from tests.llm.data import SMALL, documents, edge_rows, edited, prose, shingle_set


def brute(rows):
    """(doc_id, number of shingles, component) of each row; a doc_id's rows are one document."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                having[g].append(k)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        common = Counter(o for g in s for o in having[g] if o < k)
        for o, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[o][1]) - n):
                a, b = find(i), find(sets[o][0])
                parent[max(a, b)] = min(a, b)
    return sorted((repr(i), len(s), None if i is None else find(i)) for i, s in sets)


def ours(df):
    return sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in df.collect())


def test_as_brute_force(spark):
    df = QUERIES["op5_ngram_jaccard_join"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert ours(df) == brute([(r.doc_id, r.text) for r in docs])


def groups():
    """Copies, near copies of all degrees, chains, and a passage that many texts share."""
    rng = random.Random(7)
    passage = prose(99, 60)
    texts = [prose(i, rng.randint(1, 60)) for i in range(60)]
    texts += [f"{prose(300 + i, 200)} {passage}" for i in range(30)]
    texts += [passage] * 5 + [f"{passage} {prose(400 + i, 9)}" for i in range(10)]
    base = prose(500, 150)
    texts += [edited(base, i, rng.choice([0.0, 0.01, 0.02, 0.03])) for i in range(120)]
    chain = prose(600, 100).split()
    for i in range(40):  # each links with its neighbours only
        texts.append(" ".join(chain))
        at = (i * 7) % 90
        chain[at : at + 3] = [f"c{i}a", f"c{i}b", f"c{i}c"]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("unit,block", [(2 << 20, 2048), (3000, 8)])
def test_groups(spark, monkeypatch, unit, block):
    monkeypatch.setattr(substring, "UNIT", unit)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = groups()
    df = ngram_join.near_duplicates(documents(spark, [(i, t, None, None) for i, t in rows]))
    assert ours(df) == brute(rows)


def test_edges(spark):
    rows = edge_rows() + [(6, prose(3, 50), None, None), (20, prose(3, 50), None, None)]
    docs = documents(spark, rows)
    got = ours(ngram_join.near_duplicates(docs))
    assert got == brute([(r[0], r[1]) for r in rows])
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 8, 9]
    assert ids.count(None) == 2


def test_pairs_of_a_common_token(spark):
    """A component of many sets and others: no pair inside it is made, and none across is lost."""
    sizes = {0: 3000, 3000: 1, 3001: 2, 3003: 3}
    rows = [(5, c + i, c) for c, n in sizes.items() for i in range(n)]
    rows += [(6, 0, 0), (6, 1, 0), (7, 3000, 3000), (7, 3001, 3001)]
    postings = spark.createDataFrame(
        [(node, 10, 0, token, 0) for token, node, _ in rows],
        "node long, n long, own long, token long, place long",
    )
    label = spark.createDataFrame(
        sorted({(node, c) for _, node, c in rows}), "node long, component long"
    )
    pairs = ngram_join.open_pairs(postings, label)
    found = {tuple(r) for r in pairs.collect()}
    component = {node: c for _, node, c in rows}
    nodes = sorted(component)
    want = {(a, b) for b in nodes if b >= 3000 for a in nodes if a < b and component[a] != component[b]}
    assert found == want and len(found) == 3000 * 6 + 2 + 3 + 6


def test_prefix_tree_skips_only_what_cannot_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.choice(80, size=rng.integers(5, 60), replace=False).astype(np.uint64)
        sets.append(np.sort(base)[::-1])
        sets.append(np.sort(base[rng.random(len(base)) > 0.1])[::-1])
    sets = [s for s in sets if len(s)]
    sizes = [len(s) + int(rng.integers(0, 3)) for s in sets]
    tree = ngram_join.PrefixTree(sets, sizes)
    open_ = np.ones(len(sets), dtype=bool)
    for i in range(len(sets)):
        want = [
            j
            for j in range(len(sets))
            if len(set(tree.sets[i]) & set(tree.sets[j]))
            >= ngram_join.least_overlap(int(tree.sizes[i]), int(tree.sizes[j]))
        ]
        assert sorted(tree.linked(i, open_)) == want
