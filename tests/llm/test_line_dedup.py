import hashlib
from collections import defaultdict

import pytest

from runlens.llm import line_dedup
from tests.llm.data import LOW, documents, edge_rows, rows_of

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return line.strip(BLANKS).translate(LOW)


def plain(rows, min_docs=5, min_chars=40):
    """What the operator gives, line by line."""
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(-1 if i is None else i)
    shared = {
        k: max(ids) for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs
    }
    out = []
    for i, text, *_ in rows:
        lines, own = (text or "").split("\n"), -1 if i is None else i
        kept = [x for x in lines if shared.get(key_of(x), own) == own]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((i, len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=repr)


LONG = "A line that every page of this host carries, again and again"
ODD = "\x0c Ünïcode Ätherische Zeile die sich überall wiederholt, ÄÖÜ"


def shared_rows():
    rows = [(i, f"own {i}\n{LONG}\n\n  {LONG.upper()}\t\nend", "en", "a") for i in range(10, 16)]
    rows += [(i, f"{ODD}\r\nx\n{LONG}", "de", "b") for i in range(20, 26)]
    rows += [(30, ODD.replace("Ü", "ü") + "\n" + LONG[:39], "de", "b")]
    rows += [(i, LONG[:39], "de", "b") for i in range(31, 39)]  # one code point too short
    rows += [(40, "\n".join([LONG] * 1000 + [f"line {i}" for i in range(1000)]), "en", "c")]
    rows += [(None, f"{LONG}\nno id {i}", None, None) for i in range(3)]
    return rows


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_lines_shared_by_documents(spark, broadcast):
    rows = shared_rows() + edge_rows()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = rows_of(line_dedup.deduplicated(documents(spark, rows), digest=True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found == plain(rows)
    lost = {i: n for i, _, n, _ in found}
    assert lost[40] == 0 and lost[10] == 2 and lost[25] == 1 and lost[31] == 0


def test_one_document_does_not_make_a_crowd(spark):
    rows = [(1, LONG, "en", "a")] * 9 + [(i, LONG, "en", "a") for i in (2, 3)]
    rows += [(None, f"{LONG}\n{i}", "en", "a") for i in range(9)]
    docs = documents(spark, rows)
    assert rows_of(line_dedup.deduplicated(docs, digest=True)) == plain(rows)
    assert rows_of(line_dedup.deduplicated(docs, min_docs=4, digest=True)) == plain(rows, 4)


def test_texts_that_stay(spark):
    rows = [(i, f"{i}\n{LONG}\nz", "en", "a") for i in range(5)] + [(9, None, "en", "a")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(documents(spark, rows)).collect()}
    assert found == {**{i: f"{i}\nz" for i in range(4)}, 4: f"4\n{LONG}\nz", 9: None}


def test_empty_table(spark):
    assert line_dedup.deduplicated(documents(spark, []), digest=True).collect() == []


def test_heavy_line_is_counted_before_it_moves(spark):
    docs = documents(spark, [(i, LONG, "en", "a") for i in range(3)])
    text = line_dedup.shared_keys(line_dedup.keyed_lines(docs))._jdf.queryExecution().toString()
    assert "partial_count" in text and "Python" not in text
