"""Language identification and the quality model: held-out results and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import language_id as L
from runlens.llm import quality_gam as Q
from runlens.llm.queries import QUERIES
from tests.llm.data import documents, edge_rows

DATA = "/root/testdata/sf0.01"


def test_languages_of_held_out_texts(spark):
    found = QUERIES["op2_kneser_ney_language_id"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 250
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.accepted for r in rows]) > 0.995


def test_model_is_a_distribution():
    """Kneser-Ney probabilities of all symbols after a context add up to one."""
    words = ["the", "then", "than", "this", "hat", "tin", "thin"] * 3 + ["that"]
    grams = {}
    for w in words:
        padded = "   " + w + " "
        for i in range(len(padded) - 3):
            grams[padded[i : i + 4]] = grams.get(padded[i : i + 4], 0) + 1
    points = np.array([[ord(c) for c in g] for g in grams], dtype=np.uint32)
    model = L.CharModel(points, np.array(list(grams.values())))
    alphabet = sorted({ord(c) for g in grams for c in g[-1]})
    for context in ("   ", "  t", " th", "hin", "xyz", "thx"):
        symbols = np.array([[*map(ord, context), c] for c in alphabet], dtype=np.uint32).reshape(-1)
        at = np.arange(len(alphabet)) * 4 + 3
        ending = dict(enumerate(L.gram_hashes(symbols, at, 4), 1))
        before = dict(enumerate(L.gram_hashes(symbols, at - 1, 3), 1))
        p = np.exp(model.log_probabilities(ending, before))
        # What is missing is what the model leaves for symbols that it never saw.
        assert 0.9 < p.sum() < 1.0 + 1e-6


@pytest.fixture(scope="module")
def tool(spark):
    return L.train(documents(spark, edge_rows()))


def test_language_edges(spark, tool):
    rows = edge_rows()
    found = L.identify(documents(spark, rows), tool)
    got = {(r.doc_id, r.lang_pred) for r in found.collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und"), (None, "und")} <= got
    assert found.count() == len(rows)
    for r in found.where("lang_pred = 'und'").collect():
        assert r.score == 0 and not r.accepted
    docs = documents(spark, rows)
    assert L.identify(docs.limit(0), tool).count() == 0
    kept = L.accepted_rows(docs, tool)
    assert kept.columns == docs.columns
    assert kept.count() == found.where("accepted").count()


def test_no_training_texts(spark):
    docs = documents(spark, edge_rows())
    none = L.train(docs.where("false"))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.accepted_rows(docs, none).count() == 0


def test_no_language_loses_grams_to_others(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for lang, first, n in (("ko", 0xAC00, 150), ("zh", 0x4E00, 350)):
        texts = ["".join(map(chr, first + rng.integers(0, 5000, 1000))) for _ in range(n)]
        padded = [f"   {x} " for x in texts]
        want[lang] = len({x[i : i + 4] for x in padded for i in range(len(x) - 3)})
        rows += [(i, x, lang, "a") for i, x in enumerate(texts)]
    many = L.train(documents(spark, rows))
    assert sum(want.values()) > 450_000
    assert {x: len(m.keys[4]) for x, m in zip(many.names, many.models, strict=True)} == want


def test_limits_come_from_all_texts(spark):
    """Each language has one, and a garbled text with its label does not open it."""
    rng = np.random.default_rng(2)
    letters = lambda low, n: "".join(map(chr, low + rng.integers(0, 5, n)))
    text = lambda low: " ".join(letters(low, 5) for _ in range(40))
    rows = [(i, text(97), "aa", "a") for i in range(6000)] + [(7000, text(110), "bb", "a")]
    rows += [(8000, " ".join(chr(0x3B1 + i % 17) * 3 for i in range(400)), "aa", "a")]
    trained = L.train(documents(spark, rows))
    assert set(trained.limits) == {"aa", "bb"}
    assert {z for _, _, z in trained.limits.values()} == {L.Z}
    found = {r.doc_id: r.accepted for r in L.identify(documents(spark, rows), trained).collect()}
    assert not found[8000] and sum(found.values()) == 6001
    del trained.limits["bb"]
    assert L.accepted_rows(documents(spark, rows[6000:6001]), trained).count() == 0


def test_rejects_what_is_no_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    trained = L.train(docs)
    odd = docs.limit(20).withColumn(
        "text", F.expr("translate(text, 'aeiouthnsrl', 'qxzjkwvypfb')")
    )
    assert L.accepted_rows(odd, trained).count() <= 2


def test_quality_of_held_out_labels(spark):
    found = QUERIES["op7_additive_quality"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in found.collect())


def test_quality_edges(spark):
    docs = documents(spark, edge_rows())
    labels = spark.createDataFrame(
        [(4, 1), (6, 0), (6, 0), (7, 0), (9, 1), (99, 1), (None, 1), (8, None)],
        "doc_id long, quality int",
    )
    model = Q.train(docs, labels)
    found = Q.scored(docs, model).collect()
    assert len(found) == len(edge_rows())
    assert all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    nothing = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.scored(docs, nothing).collect()} == {0.5}
    assert Q.scored(docs.limit(0), model).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = Q.AdditiveModel().fit(x, y).score(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.9
