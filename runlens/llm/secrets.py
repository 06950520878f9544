"""Secret scans: plain patterns, and guess cost for values in the context of a credential.

Three base kinds are found by pattern alone. The method adds a fourth, ``guess``: a value in a
credential context (``DB_PWD = ...``, ``Authorization: Bearer ...``, ``user:...@host``) whose cheapest
segmentation into known words, dates, repeats, keyboard walks and brute-force characters needs at
least ``10**min_log10`` guesses. The cost of a segmentation is the sum of the parts' log guesses
plus log(i) for its i-th part; a dynamic program over the end of the last part finds the minimum.

Known words are a list of common passwords and, ranked behind these, the words of the corpus by the
number of documents that have them outside of credential contexts and of other secrets. Values that
the list alone leaves unguessable are *open*: they are stored, their letter runs are joined with the
stored ranks of the corpus's words, and each is costed anew with the words that occur in it. What is
then still unguessable comes back to the texts by a join on the text's hash. Nothing of this goes
through the driver; without open values words are not counted.

Defined results: a word counts from ``MIN_DOCS`` documents on, since what stands in one or two may
be a secret; words with as many documents have the rank of the last of them; null and empty texts have no spans; a span that a base kind already has is not
given again; offsets are code points of the whole text; values of any length are costed whole; equal
texts have equal spans.
"""

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runlens.llm.text import chunks, column_bytes, lean
from runlens.operators.facts import attach
from runlens.operators.ordering import accumulated, spread
from runlens.sources.store import settle

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE,
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
# A keyword may end a longer name: after an underscore (DB_PASS), or as a new word (dbPass).
_START = rb"(?:(?<![a-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))"
_VALUE = rb"[\"']?([^\x00-\x20\"'<>]{6,})"
CONTEXTS = (
    re.compile(
        _START + rb"(?:pwd|pass|passphrase|passcode|credentials?|auth|authorization|bearer|"
        rb"private[_-]?key|access[_-]?key|client[_-]?secret|secret[_-]?key|auth[_-]?token|"
        rb"secret[_-]?access[_-]?key|password|passwd|secret|token|api[_-]?key)"
        rb"[\"']?\x20*(?:[:=]|\x20is\x20|=>)\x20*[\"']?(?:(?:bearer|basic|token)\x20+)?" + _VALUE,
        re.IGNORECASE,
    ),
    re.compile(rb"(?<![a-z0-9])bearer\x20+" + _VALUE, re.IGNORECASE),
    re.compile(rb"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:([^\x00-\x20/:@]{6,})@", re.IGNORECASE),
)
#: Each match of ASSIGN and of the first two contexts has one of these.
KEYWORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer")
# Passwords and words that are tried first, roughly by how often they are used.
COMMON = (
    "password 123456 qwerty abc123 letmein monkey dragon iloveyou admin welcome login master "
    "hello freedom whatever trustno1 sunshine princess football baseball shadow superman batman "
    "secret changeme default guest root test user pass passwd token key example sample demo "
    "none null true false undefined placeholder your here value string todo xxx"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])|(?:19|20)\d\d")
_WALKS = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_WALKS |= {pair[::-1] for pair in _WALKS}
_LEETS = str.maketrans("@013457$!", "aoieast" + "si")
_RUN = re.compile(r"[^\W\d_]{3,}")
MIN_DOCS = 3
LONGEST = 32


def _alphabet(value):
    size = 0
    for pattern, n in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 33)):
        size += n if re.search(pattern, value) else 0
    return max(size, 10)


def _lengths(most, least):
    """The lengths of a run that count as parts: powers of two and the whole run."""
    if most < least:
        return []
    return sorted({most, *(1 << k for k in range(most.bit_length()) if (1 << k) >= least)})


class Ranks(dict):
    """Ranks of words, with the length of the longest."""

    def __init__(self, ranks):
        super().__init__(ranks)
        self.longest = max(map(len, self), default=0)


def common_ranks(common):
    """The words of a list by their place in it, from 1."""
    return Ranks({w: i + 1 for i, w in enumerate(common)})


def _forms(value):
    """``value`` in lower case, and with letters for digits that stand for them."""
    low = value.lower()
    return (low, low.translate(_LEETS)) if len(low) == len(value) else (value, value)


def _run_lengths(low):
    """For each place: characters from there on that walk the keyboard, or repeat at 1 to 4 places."""
    n = len(low)
    runs = [[0] * (n + 1) for _ in range(5)]
    for i in range(n - 1, -1, -1):
        runs[0][i] = runs[0][i + 1] + 1 if low[i : i + 2] in _WALKS else 0
        for unit in range(1, 5):
            if low[i] == low[i + unit : i + unit + 1]:
                runs[unit][i] = runs[unit][i + 1] + 1
    return runs


def _undominated(states, cost, count):
    """Add (cost, count) to ``states`` unless one of them is no worse in both."""
    if not any(c <= cost and k <= count for c, k in states):
        states[:] = [(c, k) for c, k in states if c < cost or k < count]
        states.append((cost, count))


def log10_guesses(value, ranks=None, limit=math.inf):
    """The log10 of the guesses that the cheapest segmentation of ``value`` needs.

    Runs (repeats of 1 to 4 characters, keyboard walks) are parts in whole or up to a power of two
    of their length, so that a value of n characters has O(n log n) parts. The program keeps, for
    each end of a last part, the pairs of cost and number of parts that no other pair beats in both.
    Costs of ``limit`` and more are all given as infinite; a limit of 10 leaves 14 parts at most,
    and a long value is given up where nothing cheaper goes on.
    """
    ranks = ranks if ranks is not None else common_ranks(COMMON)
    each = math.log10(_alphabet(value))
    n = len(value)
    low, plain = _forms(value)
    longest = ranks.longest if isinstance(ranks, Ranks) else max(map(len, ranks), default=0)
    dates = {m.start(): m.end() for m in DATE.finditer(value)}
    runs = _run_lengths(low)

    def parts(i):
        if i in dates:
            yield dates[i], math.log10(40_000)
        for j in range(i + 3, min(n, i + longest) + 1):
            for form, extra in ((low, 0.0), (plain, 0.7)):
                rank = ranks.get(form[i:j])
                if rank:
                    cased = 0.0 if value[i:j] == low[i:j] else 0.5
                    yield j, math.log10(rank + 1) + extra + cased
        for length in _lengths(runs[0][i] + 1, 3):
            yield i + length, math.log10(200 * length)
        for unit in range(1, 5):
            for times in _lengths(runs[unit][i] // unit + 1, 2 if unit > 1 else 3):
                yield i + unit * times, unit * each + math.log10(times)

    # A part costs log10 of its place as well; brute force is one part as long as it goes on.
    known, brute = {0: [(0.0, 0)]}, {}  # end of the last part -> pairs, by the kind of that part
    best = n * each  # of the whole value so far; what costs as much on the way is given up

    def reach(states, end, cost, count):
        nonlocal best
        if cost < min(best, limit):
            if end == n:
                best = cost
            else:
                _undominated(states.setdefault(end, []), cost, count)

    for i in range(n):
        here, going = known.pop(i, []), brute.pop(i, [])
        if not here and not going:
            if not known and not brute:
                break
            continue
        for cost, k in going:
            reach(brute, i + 1, cost + each, k)
        for cost, k in here:
            reach(brute, i + 1, cost + each + math.log10(k + 1), k + 1)
        for end, extra in parts(i):
            for cost, k in here + going:
                reach(known, end, cost + extra + math.log10(k + 1), k + 1)
    return best if best < limit else math.inf


def _candidates(raw):
    """Spans of the base kinds, and (start, end) of other values in credential contexts.

    The patterns with a keyword are only run where one of their keywords is in the text.
    """
    low = raw.lower()
    named = any(word in low for word in KEYWORDS)
    found = []
    if named:
        found = [
            (m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6
        ]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    contexts = CONTEXTS[:2] * named + CONTEXTS[2:] * (b"://" in raw)
    taken = sorted((s, e) for s, _, e in found)
    values = set()
    for pattern in contexts:
        for m in pattern.finditer(raw):
            s, e = m.span(1)
            while e > s and raw[e - 1 : e] in b".,;:)!?]}":
                e -= 1
            at = bisect.bisect_right(taken, (s, math.inf))
            inside = any(a <= s and e <= b for a, b in taken[max(0, at - 3) : at])
            if e - s >= 6 and not inside:
                values.add((s, e))
    return found, sorted(values)


def spans_of(raw, min_log10=10.0, ranks=None):
    """(start, kind number, end) in bytes of ``raw``, sorted, with ``ranks`` as the known words."""
    found, values = _candidates(raw)
    return sorted(found + [(s, 3, e) for s, e, _ in _open(raw, values, min_log10, ranks)])


def _open(raw, values, min_log10, ranks):
    """(start, end, value) of the ``values`` that are unguessable under ``ranks``."""
    for s, e in values:
        value = raw[s:e].decode("utf-8", "replace")
        if log10_guesses(value, ranks, min_log10) >= min_log10:
            yield s, e, value


def _words(raw):
    """The words of a text outside of secrets and of values in credential contexts."""
    found, values = _candidates(raw)
    parts, done = [], 0
    for s, e in sorted([(s, e) for s, _, e in found] + values):
        if s > done:
            parts.append(raw[done:s])
        done = max(done, e)
    rest = b" ".join([*parts, raw[done:]]).decode("utf-8", "replace").lower()
    return {m[0] for m in _RUN.finditer(rest) if len(m[0]) <= LONGEST}


def _parts(value):
    """What could be words in a value."""
    return {
        m[0][i:j]
        for form in set(_forms(value))
        for m in _RUN.finditer(form)
        for i in range(len(m[0]) - 2)
        for j in range(i + 3, min(len(m[0]), i + LONGEST) + 1)
    }


def _counted(docs, of_text):
    """(word, n) with the number of rows whose text has the word, in one row a word and more."""

    @lean
    def run(batches):
        found = {}

        def rows():
            columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in _small(batches, 0):
            buf, offs = column_bytes(batch.column(0))
            data = buf.tobytes()
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                for word in of_text(data[a:b]):
                    found[word] = found.get(word, 0) + 1
                    if len(found) >= 200_000:
                        yield rows()
                        found.clear()
        yield rows()

    rows = docs.select("text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _keys(column):
    """128 bits of hash that stand for a text or a value in joins."""
    return F.xxhash64(column), F.xxhash64(F.lit(1), column)


def open_values(docs, min_log10=10.0, common=COMMON):
    """(t1, t2, start, end, value) of each distinct text's values that ``common`` leaves unguessable."""
    base = common_ranks(common)

    @lean
    def run(batches):
        for batch in _small(batches, 0):
            buf, offs = column_bytes(batch.column(0))
            data = buf.tobytes()
            out = [[], [], [], []]
            for row, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                raw = data[a:b]
                for s, e, value in _open(raw, _candidates(raw)[1], min_log10, base):
                    start = len(raw[:s].decode("utf-8"))
                    span = row, start, start + len(raw[s:e].decode("utf-8")), value
                    for values, x in zip(out, span, strict=True):
                        values.append(x)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(rows), batch.column(2).take(rows)]
                + [pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                ["t1", "t2", "start", "end", "value"],
            )

    texts = docs.select("text", *_keys(docs["text"]))
    return texts.mapInArrow(run, "t1 long, t2 long, start long, end long, value string").distinct()


def corpus_ranks(docs, parts, listed=len(COMMON), min_docs=MIN_DOCS):
    """(word, rank) of the corpus's words that are in ``parts`` (word), behind ``listed`` ranks."""
    words = settle(_counted(docs, _words).where(F.col("n") >= min_docs), "words", packed=True)
    # A row for each number of documents; a word's rank is the number of words with as many.
    steps = words.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    order = [F.desc("n")]
    steps = accumulated(spread(steps, [], order), [], order, "words")
    steps = steps.select("n", (F.col("_upto") + F.lit(listed)).alias("rank"))
    known = words.join(parts.select("word").distinct(), "word", "left_semi")
    return attach(known, steps, ["n"]).select("word", "rank")


def guesses(docs, min_log10=10.0, common=COMMON, min_docs=MIN_DOCS):
    """(t1, t2, guesses): the unguessable values (start, end) of each text that has any.

    None if no value is open under ``common`` alone.
    """
    opened = open_values(docs, min_log10, common).select("*", *_keys(F.col("value")))
    opened = settle(opened.toDF("t1", "t2", "start", "end", "value", "v1", "v2"), "open", packed=True)
    if opened.isEmpty():
        return None
    values = opened.select("v1", "v2", "value").dropDuplicates(["v1", "v2"])
    values = settle(values, "values", packed=True)
    base = common_ranks(common)

    @lean
    def split(batches):
        for batch in batches:
            for i, value in enumerate(batch.column(2).to_pylist()):
                parts = pa.array(sorted(_parts(value)), pa.string())
                at = pa.array(np.full(len(parts), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), parts], ["v1", "v2", "word"]
                )

    parts = values.mapInArrow(split, "v1 long, v2 long, word string")
    parts = settle(parts, "parts", packed=True)
    known = parts.join(settle(corpus_ranks(docs, parts, len(base), min_docs), "ranks"), "word")
    # The words of one value, at most LONGEST for each of its characters.
    known = known.groupBy("v1", "v2").agg(F.collect_list(F.struct("word", "rank")).alias("words"))

    @lean
    def cost(batches):
        for batch in batches:
            hard = [
                log10_guesses(
                    value, Ranks({x["word"]: x["rank"] for x in words or []} | base), min_log10
                )
                >= min_log10
                for value, words in zip(
                    batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
                )
            ]
            yield batch.select([0, 1]).filter(pa.array(hard, pa.bool_()))

    ranked = attach(values, known, ["v1", "v2"], "left").select("v1", "v2", "value", "words")
    hard = settle(ranked.mapInArrow(cost, "v1 long, v2 long"), "hard")
    spans = opened.join(hard, ["v1", "v2"]).groupBy("t1", "t2")
    return settle(spans.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("guesses")), "guesses")


def _spans_of_rows(column):
    """For each row its spans of the base kinds, in code points."""
    buf, offs = column_bytes(column)
    data = buf.tobytes()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        raw = data[a:b]
        found = sorted(_candidates(raw)[0])
        if found and not raw.isascii():
            at = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=at[1:])
            found = [(int(at[s]), k, int(at[e])) for s, k, e in found]
        yield found


def _small(batches, at):
    """The rows of ``batches`` in slices whose texts (column ``at``) have about a megabyte."""
    for batch in batches:
        for row, _, offs in chunks(batch.column(at)):
            yield batch.slice(row, len(offs) - 1)


def scan(docs, min_log10=10.0, common=COMMON):
    """doc_id and ``spans``: an array of (kind, start, end), by start and then kind."""
    hidden = guesses(docs, min_log10, common)
    spans = "array<struct<start:long,kind:int,end:long>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    @lean
    def run(batches):
        for batch in _small(batches, 1):
            rows = [
                [{"start": s, "kind": k, "end": e} for s, k, e in found]
                for found in _spans_of_rows(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3), pa.array(rows, kind)],
                ["doc_id", "t1", "t2", "spans"],
            )

    texts = docs.select("doc_id", "text", *_keys(F.col("text")))
    found = texts.mapInArrow(run, f"doc_id long, t1 long, t2 long, spans {spans}")
    spans = F.col("spans")
    if hidden is not None:
        found = found.join(hidden, ["t1", "t2"], "left")
        more = F.transform(
            "guesses", lambda g: F.struct(g.start.alias("start"), F.lit(3).alias("kind"), g.end.alias("end"))
        )
        spans = F.when(F.col("guesses").isNull(), spans).otherwise(F.sort_array(F.concat(spans, more)))
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform(
        spans, lambda s: F.struct(F.get(kinds, s.kind).alias("kind"), s.start.alias("start"), s.end.alias("end"))
    )
    return found.select("doc_id", named.alias("spans"))


def digest(found):
    """Counts and hashes of the spans that ``scan`` returns."""
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    base = F.filter("spans", lambda s: s.kind != "guess")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redacted(docs, min_log10=10.0, common=COMMON, mark="[SECRET]"):
    """``docs`` with each span replaced by ``mark`` (overlapping spans by one) and n_chars set anew.

    Texts without spans stay as they are; all rows stay, with all their columns.
    """
    hidden = guesses(docs, min_log10, common)
    at, width = docs.columns.index("text"), len(docs.columns)
    rows, joined = docs, hidden is not None
    if joined:
        taken = max(map(len, docs.columns)) * "_"  # no column of docs starts with that much
        names = [f"{taken}_{name}" for name in hidden.columns]
        rows = docs.withColumns(dict(zip(names, _keys(docs["text"]), strict=False)))
        rows = rows.join(hidden.toDF(*names), names[:2], "left").select(
            *[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns], names[2]
        )

    @lean
    def run(batches):
        for batch in _small(batches, at):
            texts, sizes = [], []
            more = batch.column(width).to_pylist() if joined else [None] * batch.num_rows
            batch = batch.select(list(range(width)))
            for text, found, own in zip(
                batch.column(at).to_pylist(), _spans_of_rows(batch.column(at)), more, strict=True
            ):
                found = sorted(found + [(x["start"], 3, x["end"]) for x in own or []])
                if found:
                    parts, done = [], 0
                    for s, _, e in found:
                        if e > done:
                            if s >= done:
                                parts += [text[done:s], mark]
                            done = e
                    text = "".join([*parts, text[done:]])
                texts.append(text)
                sizes.append(None if text is None else len(text))
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))
            size = batch.schema.get_field_index("n_chars")
            if size >= 0:
                field = batch.schema.field(size)
                batch = batch.set_column(size, field, pa.array(sizes, field.type))
            yield batch

    return rows.mapInArrow(run, docs.schema)


__all__ = ["corpus_ranks", "digest", "guesses", "log10_guesses", "redacted", "scan", "spans_of"]
