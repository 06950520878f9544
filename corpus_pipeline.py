"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of
``documents``; the last returns the token ids. ``run`` stores each stage's rows before the next.
Stages with Python work set the session's rows per Arrow batch to ``BATCH_ROWS``.
"""

import public_tokenizers

from runlens.llm import bpe, language_id, mixing, ngram_join, secrets
from runlens.sources.store import settle

#: Rows of an Arrow batch. Both sides of a Python stage hold a batch of whole texts or two, and
#: 10,000 of them (the default) can be a large part of an executor.
BATCH_ROWS = 1000
TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark, docs, sf_dir):
    """Drop what the language models of the labelled documents reject."""
    _in_small_batches(spark)
    return language_id.accepted_rows(docs, language_id.train(docs))


def drop_near_duplicates(spark, docs, sf_dir):
    """Keep one document of each group whose shingle sets link."""
    _in_small_batches(spark)
    return ngram_join.one_of_each(docs)


def redact_secrets(spark, docs, sf_dir):
    """Replace secrets in the texts; every document stays."""
    _in_small_batches(spark)
    return secrets.redacted(docs)


def mix_sources(spark, docs, sf_dir):
    """Take each document as many times as its source's target asks for."""
    return mixing.mixed(docs)


def encode_tokens(spark, docs, sf_dir):
    """The token ids of each document taken."""
    _in_small_batches(spark)
    return bpe.encoded(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Language models, joins of sets and token merges have no counterpart in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name, packed=True)
    return STAGES[-1][1](spark, docs, sf_dir)
