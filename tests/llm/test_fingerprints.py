import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import bottom_k as B
from runlens.llm.queries import QUERIES
from tests.llm.data import SMALL, documents, edge_rows, edited, prose, shingle_set


def sketch(*texts):
    return B.sketches(pa.array(texts, pa.string()))


def check(df, rows):
    """``rows`` in the order of descending doc_id."""
    want = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = sketch(text, new, after)
        want.append(
            (
                i,
                len(text),
                hashlib.sha256(new.encode()).hexdigest(),
                B.as_text(a),
                B.as_text(b),
                B.resemblance(a, b),
                B.resemblance(a, c),
            )
        )
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_as_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    check(QUERIES["op6_bottom_k"](spark, SMALL), [(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_any_number_of_blocks(spark, blocks, monkeypatch):
    monkeypatch.setattr(B, "_ROWS", 4)
    rows = [(i, prose(i, i % 30), None, None) for i in range(60)]
    found = B.compare_with_edited(documents(spark, rows), blocks=blocks)
    check(found, [(r[0], r[1]) for r in rows[::-1]])


def test_edges(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    docs = documents(spark, edge_rows())
    found = B.compare_with_edited(docs)
    assert found.count() == len(edge_rows())
    check(
        B.compare_with_edited(documents(spark, rows)),
        [(r[0], r[1]) for r in sorted(rows, key=lambda r: -r[0])],
    )
    check(B.compare_with_edited(documents(spark, rows[:1])), [rows[0][:2]])
    assert B.compare_with_edited(docs.limit(0)).count() == 0
    assert B.compare_with_edited(docs.where("doc_id is null")).count() == 2
    prints = B.fingerprints(docs)
    assert prints.where("doc_id = 4").first().fingerprint == (
        prints.where("doc_id = 5").first().fingerprint
    )


def test_ids_that_no_double_holds(spark):
    ids = [x * 10**17 + i for x in (-90, -1, 0, 92) for i in range(30)]
    rows = [(x, prose(i, 8), None, None) for i, x in enumerate(ids)]
    rows = sorted(rows, key=lambda r: -r[0]) + [(None, "last one", None, None)]
    found = B.compare_with_edited(documents(spark, rows), blocks=20)
    check(found, [(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("blocks", [1, 7, 16])
@pytest.mark.parametrize("shares", [(0.9, 0.0), (0.4, 0.4), (0.0, 0.9), (1.0, 0.0), (0.02, 0.1)])
def test_equal_and_missing_ids_are_split(spark, blocks, shares):
    n = 400
    none, same = (int(n * x) for x in shares)
    ids = [None] * none + [50] * same + list(range(n - none - same))
    rows = [(x, prose(i, 6), None, None) for i, x in enumerate(ids)]
    docs = documents(spark, rows).withColumn("h", F.xxhash64("text"))
    order = docs.orderBy(F.desc_nulls_last("doc_id"), F.desc("h")).collect()
    check(B.compare_with_edited(docs, blocks=blocks), [(r.doc_id, r.text) for r in order])
    own = B._placed(docs.select("doc_id", "text"), blocks).where("ahead = 0")
    sizes = [r[1] for r in own.groupBy("block").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * n / blocks + 2


def test_estimates():
    base = prose(1, 4000, 5000)
    for every in (0.0, 0.02, 0.1):
        other = edited(base, 2, every)
        a, b = shingle_set(base), shingle_set(other)
        x, y = sketch(base, other)
        assert abs(B.resemblance(x, y) - len(a & b) / len(a | b)) < 0.15
        assert abs(B.containment(x, y) - len(a & b) / len(a)) < 0.2
        assert abs(B.distinct_count(x) / len(a) - 1) < 0.3
    small, empty = sketch("a b c d e f", "")
    assert B.distinct_count(small) == 2 and B.resemblance(empty, empty) == 1
    assert B.resemblance(small, empty) == 0 and B.containment(small, empty) == 0
    assert (B.from_text(B.as_text(small)) == small).all() and len(B.from_text("")) == 0


def test_merged_parts(spark):
    texts = [prose(i, 300) for i in range(12)]
    docs = documents(spark, [(i, t, None, "ab"[i % 2]) for i, t in enumerate(texts)])
    prints = B.fingerprints(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = {r.source: B.from_text(r.fingerprint) for r in B.merged(prints, "source").collect()}
    for k, source in enumerate("ab"):
        want = np.unique(np.concatenate(sketch(*texts[k::2])))[: B.K]
        assert (got[source] == want).all()
