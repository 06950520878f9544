"""N-gram Jaccard join: documents whose sets of 5-word shingles are alike, with a prefix tree.

Two documents link when ``100 * |A & B| >= 80 * |A | B|``; the result is the component of each
document. The steps, each exact:

1. How many documents have a shingle is counted for all shingles (each stored unit of texts sends
   a distinct shingle once). A document can only link if 80 % of its shingles occur elsewhere.
2. Those documents' sets are put in one global order, rare shingles first; equal sets become one
   class with the least doc_id, and only classes go on. Linked sets share a shingle of their
   prefixes (the first ``n - ceil(0.8 n) + 1`` of the order).
3. Blocks: each set goes to the blocks of its two most common prefix shingles; a large block is
   split by hash, differently for the two. In a block a prefix tree stores the sets, common
   shingles first. A set walks the tree: shared paths are counted once, and a subtree is left when
   the overlap so far and what can remain fall short of the need, or when all its sets are already
   in the same component.
4. Components of the links found, by repeated contraction in small joins.
5. Pairs of different components that share a prefix shingle, which no block compared, and whose
   sizes and places leave a link possible, are compared one by one, and components taken again.

So no task gets more than a bounded part of a group of near copies, and no pair inside a component
is listed. Step 5 lists pairs only across components: of a shingle's postings those of its largest
component are one side, which meets the others and never itself.

Defined results: a null or empty text has no shingles and its own component; a text of fewer than
five words is one shingle; rows of one doc_id are one document for the links (each keeps its own
``n_shingles``); a row without doc_id links with nothing and its component is null; repeated rows
stay, each with its result; other columns never matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.llm.substring import _dense, _keys, _raw, _sent, _sizes, _zstd, units, unpack
from runlens.llm.text import U64, lean, mix, parts, same_in_row, shingles
from runlens.sources.store import settle

WORDS = 5
NUM, DEN = 80, 100
BLOCK = 2048
KEYS = 2
_LOW = U64(0xFFFFFFFF)


def least_overlap(a, b):
    """The smallest overlap at which sets of these sizes link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def unit_sets(data, words):
    """(doc_id column, row, hash) of a unit: each row's distinct shingles, rows in order."""
    ids, buf, offs = unpack(data)
    rows, sets = [], []
    for at, part, own in parts(buf, offs, 1 << 19):
        row, hashes = shingles(part, own, words)
        if len(row) and (row[1:] < row[:-1]).any():
            order = np.argsort(row, kind="stable")
            row, hashes = row[order], hashes[order]
        _, again = same_in_row(row, hashes)
        rows.append(row[~again] + at)
        sets.append(hashes[~again])
    none = np.zeros(0, dtype=np.int64)
    return ids, np.concatenate(rows or [none]), np.concatenate(sets or [none.view(U64)])


def _tags(hashes, buckets):
    return (hashes >> U64(32)) % U64(buckets) << U64(32) | hashes & _LOW


def shared_shingles(stored, buckets, words=WORDS):
    """(unit, keys, counts): shingles of a unit that two documents have, and how many have them."""

    @lean
    def send(batches):
        for batch in batches:
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, hashes = unit_sets(data.as_buffer(), words)
                keys, counts = np.unique(_tags(hashes, buckets), return_counts=True)
                columns = [
                    ((keys & _LOW).astype(np.uint32), _raw),
                    (counts.astype(np.uint32), _dense),
                ]
                yield pa.RecordBatch.from_arrays(
                    _sent(buckets, keys >> U64(32), unit, columns),
                    ["bucket", "unit", "tags", "counts"],
                )

    def answer(table):
        parts = table.column("tags").to_pylist()
        sizes = _sizes(parts, 4)
        owner = np.repeat(np.arange(len(parts)), sizes)
        tags = np.concatenate([np.frombuffer(p, dtype=np.uint32) for p in parts])
        counts = np.concatenate(
            [
                np.frombuffer(_zstd().decompress(p, int(n) * 4, asbytes=True), dtype=np.uint32)
                for p, n in zip(table.column("counts").to_pylist(), sizes, strict=True)
            ]
        ).astype(np.int64)
        order = np.argsort(tags, kind="stable")
        s = tags[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        total = np.empty(len(s), dtype=np.int64)
        total[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = np.flatnonzero(total > 1)
        keys = U64(table.column("bucket")[0].as_py()) << U64(32) | tags[hit].astype(U64)
        total = total[hit].astype(np.uint64)
        bounds = np.searchsorted(owner[hit], np.arange(len(parts) + 1))
        pairs = list(zip(bounds[:-1], bounds[1:], strict=True))
        return pa.table(
            {
                "unit": table.column("unit"),
                "keys": pa.array([keys[a:b].tobytes() for a, b in pairs], pa.binary()),
                "counts": pa.array([total[a:b].tobytes() for a, b in pairs], pa.binary()),
            }
        )

    return (
        stored.mapInArrow(send, "bucket int, unit long, tags binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(answer, "unit long, keys binary, counts binary")
        .where("length(keys) > 0")
        .groupBy("unit")
        .agg(F.collect_list(F.struct("keys", "counts")).alias("shared"))
    )


def document_sets(stored, shared, buckets, words=WORDS):
    """(doc_id, n, h1, h2, own, tokens) of each row.

    ``own`` is how many shingles no other document has. ``tokens`` are the others in the global
    order, null if they are too few for a link. A token is 56 bits of its hash below 8 bits for
    how many documents have it (an eighth of a doubling each), so that numbers sort as the order.
    """

    @lean
    def run(batches):
        for batch in batches:
            for data, found in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids, row, hashes = unit_sets(data.as_buffer(), words)
                n = np.bincount(row, minlength=len(ids))
                keys = _keys([x["keys"] for x in found or []])
                counts = _keys([x["counts"] for x in found or []])
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order]
                own = _tags(hashes, buckets)
                at = np.searchsorted(keys, own)
                at[at == len(keys)] = 0
                shared_ = keys[at] == own if len(keys) else np.zeros(len(own), dtype=bool)
                count = np.bincount(row[shared_], minlength=len(ids))
                sums = []
                for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    total = np.zeros(len(hashes) + 1, dtype=U64)
                    np.cumsum(mix(hashes ^ U64(seed)), out=total[1:])
                    ends = np.cumsum(n)
                    sums.append((total[ends] - total[ends - n]).view(np.int64))
                live = DEN * count >= NUM * n
                live &= n > 0
                keep = shared_ & live[row]
                level = np.minimum(255, np.floor(8 * np.log2(counts[at[keep]].astype(float))))
                token = level.astype(U64) << U64(56) | hashes[keep] >> U64(8)
                order = np.lexsort((token, row[keep]))
                token = token[order]
                bounds = np.searchsorted(row[keep], np.arange(len(ids) + 1))
                tokens = [
                    token[a:b].tobytes() if ok else None
                    for a, b, ok in zip(bounds[:-1], bounds[1:], live.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(n),
                        *map(pa.array, sums),
                        pa.array(n - count),
                        pa.array(tokens, pa.binary()),
                    ],
                    ["doc_id", "n", "h1", "h2", "own", "tokens"],
                )

    return (
        stored.join(shared, "unit", "left")
        .select("pack", "shared")
        .mapInArrow(run, "doc_id long, n long, h1 long, h2 long, own long, tokens binary")
    )


class PrefixTree:
    """Sets of ordered tokens in a compressed trie, the most common token first.

    ``sets`` are arrays of distinct tokens in descending order, ``sizes`` the full sizes (with the
    tokens that no other document has).
    """

    def __init__(self, sets, sizes):
        self.order = sorted(range(len(sets)), key=lambda i: tuple((~sets[i]).tolist()))
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([sizes[i] for i in self.order], dtype=np.int64)
        every, codes = np.unique(np.concatenate(self.sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in self.sets])
        self.codes = np.split(codes, ends[:-1])
        self.present = np.zeros(len(every), dtype=bool)
        common = []  # of each set with the one before it
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self.nodes = []
        stack = [(0, len(self.sets), 0, None)]
        while stack:  # (first set, end, depth, parent)
            lo, hi, depth, parent = stack.pop()
            to = len(self.sets[lo]) if hi - lo == 1 else min(common[lo : hi - 1])
            at = len(self.nodes)
            rest = max(len(s) for s in self.sets[lo:hi]) - to
            self.nodes.append([lo, hi, depth, to, rest, int(self.sizes[lo:hi].min()), []])
            if parent is not None:
                self.nodes[parent][6].append(at)
            if hi - lo > 1:
                cuts = [lo, *(i + 1 for i in range(lo, hi - 1) if common[i] == to), hi]
                stack += [(a, b, to, at) for a, b in zip(cuts, cuts[1:], strict=False)]

    def linked(self, i, open_):
        """The sets among ``open_`` (a mask in tree order) that link with set ``i``."""
        mine, size = self.codes[i], int(self.sizes[i])
        before = np.concatenate(([0], np.cumsum(open_)))
        if not before[-1]:
            return []
        self.present[mine] = True
        found, stack = [], [(0, 0)]
        while stack:
            at, overlap = stack.pop()
            lo, hi, depth, to, rest, least, children = self.nodes[at]
            if before[hi] == before[lo]:
                continue
            if to > depth:
                overlap += int(np.count_nonzero(self.present[self.codes[lo][depth:to]]))
            if overlap + min(rest, len(mine) - overlap) < least_overlap(size, least):
                continue
            if hi - lo == 1:
                if overlap >= least_overlap(size, least):
                    found.append(lo)
            else:
                stack += [(c, overlap) for c in children]
        self.present[mine] = False
        return found


def join_block(sets, sizes):
    """For each set the number of another one of its component in the block (or its own)."""
    tree = PrefixTree(sets, sizes)
    n = len(sets)
    component = np.arange(n)
    for i in range(n):
        for j in tree.linked(i, component != component[i]):
            if component[j] != component[i]:
                low, high = sorted((component[i], component[j]))
                component[component == high] = low
    out = np.empty(n, dtype=np.int64)
    out[tree.order] = np.asarray(tree.order)[component]
    return out


def block_links(blocks):
    """(a, b) links that connect the components inside each block of (key, node, n, tokens)."""

    def run(table):
        sets = [np.frombuffer(t, dtype=U64)[::-1] for t in table.column("tokens").to_pylist()]
        nodes = table.column("node").to_numpy()
        to = nodes[join_block(sets, table.column("n").to_pylist())]
        real = nodes != to
        return pa.table({"a": pa.array(nodes[real]), "b": pa.array(to[real])})

    return blocks.groupBy("key", "part").applyInArrow(run, "a long, b long")


def prefixes(sets):
    """(node, n, own, token, place) of the tokens in each set's prefix."""

    @lean
    def run(batches):
        for batch in batches:
            nodes, sizes, owns = (batch.column(i).to_numpy() for i in range(3))
            lists = [np.frombuffer(t, dtype=np.int64) for t in batch.column(3).to_pylist()]
            length = sizes + (-NUM * sizes // DEN) + 1 - owns
            count = np.clip(length, 0, [len(x) for x in lists])
            token = np.concatenate(
                [x[:c] for x, c in zip(lists, count.tolist(), strict=True)] or [nodes[:0]]
            )
            first = np.cumsum(count) - count
            place = np.arange(len(token)) - np.repeat(first - owns, count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(nodes, count)),
                    pa.array(np.repeat(sizes, count)),
                    pa.array(np.repeat(owns, count)),
                    pa.array(token),
                    pa.array(place),
                ],
                ["node", "n", "own", "token", "place"],
            )

    return sets.select("node", "n", "own", "tokens").mapInArrow(
        run, "node long, n long, own long, token long, place long"
    )


def components(nodes, links):
    """(node, component): the least node that links lead to, for the nodes that have links.

    Each round every component takes the least number among its own and its neighbours', then
    follows that number once more; links inside a component are dropped. Rounds are stored.
    """
    edges = settle(links.where("a <> b").distinct(), "links", packed=True)
    label = settle(nodes.select("node", F.col("node").alias("component")), "labels", packed=True)
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        to = settle(to, "hooks", packed=True)
        again = to.select(F.col("a").alias("to"), F.col("to").alias("next"))
        to = to.join(again, "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        to = settle(to, "hooks", packed=True)
        label = settle(
            label.join(to.withColumnRenamed("a", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            "labels",
            packed=True,
        )
        edges = settle(
            edges.join(to, "a")
            .select(F.col("to").alias("a"), F.col("b").alias("a2"))
            .join(to.select(F.col("a").alias("a2"), F.col("to").alias("b")), "a2")
            .select("a", "b")
            .where("a <> b")
            .distinct(),
            "links",
            packed=True,
        )
    return label


def open_pairs(postings, label):
    """Distinct (a, b) of different components that may link, from the postings of prefix tokens."""
    known = postings.join(label, "node")
    # Of each token's postings those of its largest component never meet each other.
    sizes = known.groupBy("token", "component").agg(F.count(F.lit(1)).alias("docs"))
    mixed = (
        sizes.groupBy("token")
        .agg(F.max_by("component", F.struct("docs", "component")).alias("large"), F.count("*").alias("many"))
        .where("many > 1")
        .select("token", "large")
    )
    mixed = settle(mixed, "mixed", packed=True)
    every = settle(known.join(mixed, "token"), "open", packed=True)
    left = every.where("component <> large")
    right = every.select(*[F.col(c).alias(f"{c}_b") for c in every.columns])
    total = F.col("n") + F.col("n_b")
    need = -F.floor(-NUM * total / F.lit(NUM + DEN))
    rest = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    shared = F.least(F.col("n") - F.col("own"), F.col("n_b") - F.col("own_b"))
    return (
        left.join(right, F.col("token") == F.col("token_b"))
        .where("component < component_b or (component_b = large and component <> component_b)")
        .where((rest >= need) & (shared >= need))
        .select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
        .distinct()
    )


def compared(pairs, sets):
    """The pairs that link."""

    @lean
    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 4))
            n, m = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            both = np.array(
                [
                    len(
                        np.intersect1d(
                            np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64), True
                        )
                    )
                    for x, y in zip(a, b, strict=True)
                ],
                dtype=np.int64,
            )
            yield batch.select([0, 1]).filter(pa.array(both >= least_overlap(n, m)))

    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"), F.col("n").alias("n"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"), F.col("n").alias("m"))
    return (
        pairs.join(one, "a").join(two, "b").select("a", "b", "x", "n", "y", "m")
        .mapInArrow(run, "a long, b long")
    )


def near_duplicates(docs, words=WORDS):
    """doc_id, n_shingles and component_id of each row."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = units(docs)
    shared = shared_shingles(stored, buckets, words)
    every = settle(document_sets(stored, shared, buckets, words), "sets", packed=True)
    known = every.where("doc_id is not null and n > 0")
    ids = ["n", "h1", "h2"]
    # Stored, these facts of a heavy class or shingle are joined by several tasks.
    classes = settle(known.groupBy(*ids).agg(F.min("doc_id").alias("node")), "nodes", packed=True)
    members = settle(
        known.select("doc_id", *ids).join(classes, ids).select("doc_id", "node").distinct(),
        "members",
        packed=True,
    )
    # One set for each class; a doc_id that has several texts ties its classes together.
    sets = settle(
        known.where("tokens is not null")
        .groupBy(*ids)
        .agg(
            F.min("doc_id").alias("node"),
            F.any_value("own").alias("own"),
            F.any_value("tokens").alias("tokens"),
        )
        .select("node", "n", "own", "tokens"),
        "classes",
        packed=True,
    )
    postings = prefixes(sets)
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    counts = settle(counts, "counts", packed=True)
    postings = settle(postings.join(counts, "token"), "postings", packed=True)
    ranked = Window.partitionBy("node").orderBy(F.desc("docs"), "token")
    keys = (
        postings.withColumn("i", F.row_number().over(ranked))
        .where(F.col("i") <= KEYS)
        .select(
            "node",
            F.col("token").alias("key"),
            F.pmod(
                F.xxhash64("node", "i"), F.ceil(F.col("docs") / F.lit(BLOCK)).cast("long")
            ).alias("part"),
        )
        .distinct()
    )
    links = block_links(keys.join(sets, "node").select("key", "part", "node", "n", "tokens"))
    same = members.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    nodes = members.select("doc_id").distinct().select(F.col("doc_id").alias("node"))
    first = components(nodes, links.union(same))
    more = compared(open_pairs(postings, first), sets)
    merged = more.join(first.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(
        first.select(F.col("node").alias("b"), F.col("component").alias("y")), "b"
    )
    top = components(
        first.select(F.col("component").alias("node")).distinct(),
        merged.select(F.col("x").alias("a"), F.col("y").alias("b")),
    )
    found = first.join(
        top.select(F.col("node").alias("component"), F.col("component").alias("component_id")),
        "component",
    ).select(F.col("node").alias("doc_id"), "component_id")
    return every.join(found, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs, words=WORDS):
    """``docs`` with one document of each component, that of the least doc_id.

    Of several rows of that doc_id one stays; rows without doc_id all stay.
    """
    found = near_duplicates(docs, words)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    many = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    many = settle(many.where("rows > 1").select("doc_id"), "many")
    gone = settle(gone, "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    single = kept.join(many, "doc_id", "left_anti").select(docs.columns)
    one = kept.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return single.unionByName(one)
