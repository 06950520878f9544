import pytest
from pyspark.sql import functions as F

from checks.compare import connect, rows_of
from runlens.llm import mixing
from runlens.llm.queries import ORACLES, QUERIES
from tests.llm.data import SMALL, documents, edge_rows, prose
from tests.test_plans import plan


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_as_sql(spark, sf):
    df = QUERIES["op4_mixing"](spark, sf)
    found = connect(sf).execute(ORACLES["op4_mixing"])
    names = [d[0] for d in found.description]
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(names, found.fetchall())
    text = plan(df)
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def check(got, weights):
    sources = {}
    for source, doc, size, own, target, copies in got:
        assert 0 <= copies <= 3
        part = sources.setdefault(source, [0, 0, own, target, 0])
        part[0] += size
        part[1] += size * copies
        part[4] = max(part[4], size)
    total = sum(p[0] for p in sources.values())
    for size, taken, own, target, largest in sources.values():
        assert own == size and target <= 3 * size
        assert abs(taken - target) <= 2 * largest + 1
    assert abs(sum(p[3] for p in sources.values()) - total) < 1e-6 * max(total, 1)
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    level = [p[3] / weight[s] for s, p in sources.items() if p[3] < 3 * p[0]]
    if level:  # those below their bound share alike, those at it would get more
        assert max(level) - min(level) < 1e-6 * max(level)
        assert all(3 * p[0] / weight[s] <= max(level) + 1e-6 for s, p in sources.items() if p[3] == 3 * p[0])


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (1, 9)])
def test_targets(spark, weights):
    rows = [
        (i, prose(i, 3 + i % 40), "en", ["a", "b", "c", None, "a", "a"][i % 6]) for i in range(300)
    ] + [(1000 + i, prose(i, 4), "en", "d") for i in range(3)]
    docs = documents(spark, rows)
    found = mixing.planned(docs, weights, row=F.col("source"))
    got = [
        (r._row, r.doc_id, r.size, r.source_size, r.target, r.copies) for r in found.collect()
    ]
    assert len(got) == len(rows)
    check(got, weights)
    again = mixing.planned(docs.repartition(7), weights)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "copies").collect()))
    assert key(found) == key(again)


def test_edges(spark):
    docs = documents(spark, edge_rows())
    found = mixing.planned(docs).collect()
    assert len(found) == len(edge_rows())
    assert all(r.copies * r.size == 0 for r in found if r.size == 0)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in found)
    assert mixing.planned(docs.limit(0)).count() == 0
    blank = documents(spark, [(1, None, None, "a"), (2, " ", None, None)])
    assert [(r.target, r.copies) for r in mixing.planned(blank).collect()] == [(0.0, 0)] * 2
