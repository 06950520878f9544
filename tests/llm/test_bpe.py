import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import bpe
from runlens.llm.text import column_bytes
from tests.llm.data import SMALL, documents, edge_rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.encoder(bpe._ranks_of(PATH))


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={}
    )


def same(ours, theirs, texts):
    buf, offs = column_bytes(pa.array(texts, pa.string()))
    ids, at = ours.encode(buf, offs)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == theirs.encode_ordinary(t), t
        assert ours.decode(own).tobytes() == t.encode()


PIECES = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "1", "!", " 's", "'S"]
PIECES += ["\xa0", "　", "日本", "😀", "\x1c", "\x85", "́", "aaaa", "----", "<|endoftext|>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=6))
def test_as_tiktoken(ours, theirs, texts):
    same(ours, theirs, texts)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_as_tiktoken_on_any_characters(ours, theirs, texts):
    same(ours, theirs, texts)


def test_long_runs(ours, theirs):
    same(ours, theirs, ["a" * 3001, "-=" * 777, " " * 99, "aaa" * 50 + "'ll've", ""])


def test_pattern_and_reach(ours):
    assert bpe.PATTERN == public_tokenizers.PATTERN
    assert ours.unreachable() == []


def test_vocabulary_that_is_not_reached(tmp_path):
    path = tmp_path / "odd"
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc"]  # without "ab" and "bc"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    with pytest.raises(ValueError):
        bpe._ranks_of(str(path))


def check(df, theirs, rows):
    want = sorted(
        (
            i if i is not None else -1,
            len(ids),
            hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest(),
        )
        for i, t in rows
        for ids in [theirs.encode_ordinary(t or "")]
    )
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, df.collect()))
    assert got == want


def test_digest(spark, theirs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(bpe.digest(docs, PATH), theirs, [(r.doc_id, r.text) for r in docs.collect()])


def test_edges_and_round_trip(spark, theirs):
    docs = documents(spark, edge_rows())
    check(bpe.digest(docs, PATH), theirs, [(r[0], r[1]) for r in edge_rows()])
    assert bpe.digest(docs.limit(0), PATH).count() == 0
    tokens = bpe.encoded(docs, PATH)
    back = bpe.decoded(tokens.where("doc_id is not null").distinct(), PATH)
    texts = {r[0]: (r[1] or "") for r in edge_rows() if r[0] is not None}
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == texts
    none = tokens.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(1)
    assert bytes(bpe.decoded(none, PATH).first().data) == b""
