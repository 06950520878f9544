"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over the nested tags of a host's pages: elements,
repeated groups ``(...)+``, optional groups ``(...)?`` and text slots ``#``. It is inferred by
aligning page after page with what is there: the children of two matching elements are aligned by
their longest common subsequence; what only one side has becomes optional; siblings that follow
each other in turn become one repeated group; texts that differ become a slot, equal ones stay
fixed text. Two wrappers align like two pages, so a host's pages are dealt into groups by a hash of
their wrappers, each group is folded in the order of the hashes, and the groups' wrappers are folded
in rounds: no task sees all pages of a host, and the order of the rows never matters.

From a host's wrapper follows where its main text lies: at the places where any of its pages has an
``article`` or ``main``, and for pages that have nothing there in the smallest element that holds
most of the other slots' text. A page's blocks inside are its text, without what tag, role, class or
id mark as a menu, header, footer, sidebar, notice, advert, form or comment, and without fixed text.
Marks by form, role, class or id say nothing on an element that holds most of the host's slot text,
unless they are those of comments. Fixed text is what each page with a place has there, if at least
``LEAST_PAGES`` pages of different text have the place and so do half of those with its region (a
quarter of the host's, outside of regions). Texts of any length are compared, by hash. A repeated
group whose texts differ is a slot, so a line that all pages have among their paragraphs, with
nothing that tells it apart, stays.

Defined results: a null or empty page has the empty text; tags that are cut off or never closed
end where their parent does; elements below ``LEVELS`` open ones count as children of the last of
these, told apart by a hash of their path; pages without a host are one host; a page that has no text at any of
its host's places is read by its own wrapper, without the host's fixed text; a host whose pages
are copies of fewer than ``LEAST_PAGES`` has no fixed text; repeated rows have the same text; other
columns never matter.
"""

import functools
import hashlib
import html
import json
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runlens.operators.facts import attach

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label link mark meta "
    "output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input "
    "source track area base col embed param picture audio video canvas map object".split()
)
_CELLS = {"td", "th", "dt", "dd", "li", "option", "tr", "p"}
#: What the start of an element of this name closes, if it is the innermost open block.
_CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_DROPPED = {"nav", "footer", "aside", "menu", "dialog", "select", "button", "fieldset"}
_DROPPED |= _RAW | {"head"}
_MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing related recommended comment comments commentlist reply replies disqus "
    "discussion widget pagination pager toolbar masthead copyright contentinfo complementary search "
    "dialog form skip".split()
)
#: Marks of comments hold whatever the size of what they mark.
_COMMENTS = {"comment", "comments", "commentlist", "reply", "replies", "disqus", "discussion"}
#: In a class name with one of these a mark tells of something elsewhere (``has-sidebar``).
_STATES = {"has", "with", "no", "without", "is", "open", "closed", "hide", "enabled", "disabled"}
#: On elements of text these words say nothing (``<p class="search-tips">``).
_WEAK = {"dialog", "form", "search", "skip", "header", "footer", "menu", "login", "signup", "widget"}
_WEAK |= {"discussion", "reply", "replies", "notice", "alert", "complementary"}
_TEXTS = set("p blockquote pre h1 h2 h3 h4 h5 h6 li dt dd td th".split())
_WHOLE = {"html", "body", "main"}
_REGIONS = {"article", "main"}
_SPACES = re.compile(r"\s+")
LEAST_PAGES = 3
LEVELS = 200


@functools.lru_cache(1 << 16)
def _signature(name, attrs):
    """(label, whether it is no part of any article, whether a header, whether a region).

    The label is the name with the words of class, id and role, and ends in ``!`` if these or the
    name mark the element, in ``!!`` if they mark comments.
    """
    found = {}
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        found.setdefault(key.lower(), a or b or c)
    own = " ".join(found.get(x, "") for x in ("class", "id", "role")).lower()
    own = re.sub(r"\d+", "", html.unescape(own))
    words, marks = set(), set()
    for token in own.split():
        parts = set(re.split(r"[^a-z]+", token)) - {""}
        words |= parts
        if not parts & _STATES:
            marks |= parts & _MARKS
    style = found.get("style", "").replace(" ", "").lower()
    dropped = name in _DROPPED or "display:none" in style or found.get("aria-hidden") == "true"
    dropped |= "hidden" in found
    header = name == "header" or "header" in marks
    marks -= {"header"} | (_WEAK if name in _TEXTS else set())
    label = f"{name}.{'.'.join(sorted(words))}" if words else name
    if name not in _WHOLE and (marks or name == "form"):
        label += "!!" if marks & _COMMENTS else "!"
    region = name in _REGIONS or found.get("role", "").lower() == "main"
    header = header and name not in _WHOLE | _REGIONS | _TEXTS
    return label, dropped, header, region


def _below(path, label):
    """The path of an element in that of its parent."""
    if len(path) < LEVELS:
        return (*path, label)
    last = path[-1].rsplit("/", 1)[-1] if "/" in path[-1] else path[-1]
    key = hashlib.blake2b(f"{last}\0{label}".encode("utf-8", "replace"), digest_size=8).hexdigest()
    mark = max(last[len(last.rstrip("!")) :], label[len(label.rstrip("!")) :], key=len)
    return (*path[:-1], f"{path[-1].split('/')[0].rstrip('!')}/{key}{mark}")


def _marked(path, void=frozenset()):
    """Whether an element of ``path`` is marked, but for the paths ``void``."""
    return any(x[-1:] == "!" and path[: i + 1] not in void for i, x in enumerate(path))


def blocks(page):
    """(path, text, link characters, dropped, region) of each block of text, in page order.

    ``path`` is the tuple of the labels of the open block elements, whose marks are not in
    ``dropped`` yet; ``region`` is the length of the part that leads to the outermost ``article``
    or ``main``, or 0.
    """
    out, stack, parts = [], [], []
    linked = in_link = 0
    at, end = 0, len(page)

    def flush():
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                top = stack[-1] if stack else ("", (), False, 0, "")
                out.append((top[1], text, min(linked, len(text)), top[2], top[3]))
        linked = 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            parts.append(page[at:lt])
            if in_link:
                linked += lt - at
        if lt == end:
            break
        m = _TAG.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name in _RAW:
            if not m[1] and not m[3].endswith("/"):
                close = re.compile(rf"</{name}[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name in _INLINE:
            if name == "a":
                in_link = 0 if m[1] else 1
            elif name in ("br", "img", "wbr"):
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name == "hr":
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        while stack and stack[-1][0] in _CLOSES.get(name, ()):
            stack.pop()
        label, dropped, header, region = _signature(name, m[3])
        if stack:
            _, path, drop, inside, _ = stack[-1]
        else:
            path, drop, inside = (), False, 0
        # A header is the page's unless it is inside the article.
        drop = drop or dropped or (header and not inside)
        path = _below(path, label)
        inside = inside or (len(path) if region else 0)
        stack.append((name, path, drop, inside, ""))
        if m[3].endswith("/"):
            stack.pop()
    flush()
    return out


# --- wrappers: label, children, repeated, optional, text, chars, linked, pages, dropped or region --
# text: None, or ["fixed", value (its start, if long), key], or ["slot"]; children of a repeated run:
# one node stands for all; g: length of the path to the region; w: the smallest hashes of different
# pages that have the node, LEAST_PAGES at most.


def _node(label):
    counts = {"n": 0, "k": 0, "p": 1, "d": 0, "g": 0, "w": []}
    return {"l": label, "c": [], "r": 0, "o": 0, "t": None} | counts


def _key(path, text):
    """A text of any length at its place."""
    both = "\0".join((*path, "", text)).encode("utf-8", "surrogatepass")
    return hashlib.blake2b(both, digest_size=10).hexdigest()


def page_wrapper(found):
    """The wrapper of one page, from its blocks."""
    keys = [_key(path, text) for path, text, *_ in found]
    own = [int(hashlib.blake2b("".join(keys).encode(), digest_size=6).hexdigest(), 16)]
    root = _node("") | {"w": own}
    open_nodes = [root]
    previous = ()
    for (path, text, linked, dropped, inside), key in zip(found, keys, strict=True):
        same = 0
        while same < min(len(path), len(previous)) and path[same] == previous[same]:
            same += 1
        again = same == len(path) == len(previous) > 0  # the next one of the same kind
        del open_nodes[same + 1 :]
        for label in path[same:]:
            node = _node(label) | {"w": own}
            open_nodes[-1]["c"].append(node)
            open_nodes.append(node)
        node = open_nodes[-1]
        node["r"] |= again
        node["t"] = _texts(node["t"], text if len(text) <= 200 else f"{text[:200]}...", key)
        node["n"] += len(text)
        node["k"] += linked
        node["d"] = 1 if dropped else 2 if inside else 0
        node["g"] = inside
        previous = path
    _fold(root)
    return root


def _texts(known, text, key):
    """The text of a place after one more text: fixed while all are equal, then a slot."""
    value = ["fixed", text, key]
    return value if known is None or known == value else ["slot"]


def _fold(node):
    """Turn siblings that repeat in turn into one repeated group each, innermost first."""
    for child in node["c"]:
        _fold(child)
    for period in range(1, 5):
        items, low = [], 0
        for child in node["c"]:
            items.append(child)
            i = len(items) - 2 * period
            if i >= low and all(
                items[i + j]["l"] == items[i + period + j]["l"] for j in range(period)
            ):
                low = i
                for j in range(period):
                    items[i + j] = align(items[i + j], items[i + period + j], True)
                    items[i + j]["r"] = 1
                del items[i + period :]
        node["c"] = items


def _lengths(x, y):
    """The length of the longest common subsequence of x and y[:j], for each j.

    A bit for each position of y, all moved at once for each label of x.
    """
    at = {}
    for j, label in enumerate(y):
        at.setdefault(label, []).append(j)
    masks = {}
    for label, places in at.items():
        bits = np.zeros(len(y), dtype=np.uint8)
        bits[places] = 1
        masks[label] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(y)) - 1
    state = full
    for label in x:
        both = state & masks.get(label, 0)
        if both:
            state = ((state + both) | (state - both)) & full
    raw = np.frombuffer((full ^ state).to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8)
    bits = np.unpackbits(raw, bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def _table(x, y):
    """The pairs of a longest common subsequence of two short lists."""
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            if x[i] == y[j]:
                best[i][j] = best[i + 1][j + 1] + 1
            else:
                best[i][j] = max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n and j < m:
        if x[i] == y[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1


def common(x, y):
    """The pairs (i, j) of a longest common subsequence, in memory that grows with the lists.

    Halves of x meet the part of y that fits them best (Hirschberg), down to tables of 4096 cells.
    """
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        tail = 0
        while a < b - tail and c < d - tail and x[b - 1 - tail] == y[d - 1 - tail]:
            tail += 1
        out.extend((b - 1 - i, d - 1 - i) for i in range(tail))
        b, d = b - tail, d - tail
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= 4096 or b - a == 1:
            out.extend((a + i, c + j) for i, j in _table(x[a:b], y[c:d]))
            continue
        half = (a + b) // 2
        ahead = _lengths(x[a:half], y[c:d])
        back = _lengths(x[half:b][::-1], y[c:d][::-1])[::-1]
        cut = c + int(np.argmax(ahead + back))
        todo += [(half, b, cut, d), (a, half, c, cut)]
    return sorted(out)


def align(a, b, one_page=False):
    """The wrapper of what either of two nodes of the same label stands for."""
    x, y = a["c"], b["c"]
    n, m = len(x), len(y)
    if [c["l"] for c in x] == [c["l"] for c in y]:
        children = [align(p, q, one_page) for p, q in zip(x, y, strict=True)]
    else:
        children, i, j = [], 0, 0
        for p, q in [*common([c["l"] for c in x], [c["l"] for c in y]), (n, m)]:
            children += [c | {"o": 1} for c in (*x[i:p], *y[j:q])]
            if p < n:
                children.append(align(x[p], y[q], one_page))
            i, j = p + 1, q + 1
    out = _node(a["l"]) | {"c": children}
    for key in ("r", "o", "d", "g"):
        out[key] = max(a[key], b[key])
    for key in ("n", "k"):
        out[key] = a[key] + b[key]
    out["p"] = max(a["p"], b["p"]) if one_page else a["p"] + b["p"]
    out["w"] = a["w"] if a["w"] == b["w"] else sorted({*a["w"], *b["w"]})[:LEAST_PAGES]
    if a["t"] and b["t"]:
        out["t"] = a["t"] if a["t"] == b["t"] else ["slot"]
    else:
        out["t"] = a["t"] or b["t"]
    items = [c["l"] for c in children]
    if any(p == q for p, q in zip(items, items[1:], strict=False)):
        _fold_level(out)
    return out


def _fold_level(node):
    """Merge neighbours of one label, which an alignment of optional parts may leave."""
    merged = []
    for child in node["c"]:
        if merged and merged[-1]["l"] == child["l"]:
            merged[-1] = align(merged[-1], child, True) | {"r": 1}
        else:
            merged.append(child)
    node["c"] = merged


def expression(node):
    """The wrapper written as a regular expression."""
    inner = "".join(expression(c) for c in node["c"])
    if node["t"]:
        inner = ("#" if node["t"][0] == "slot" else html.escape(node["t"][1])) + inner
    text = f"<{node['l']}>{inner}</{node['l'].split('.')[0]}>" if node["l"] else inner
    mark = "*" if node["r"] and node["o"] else "+" if node["r"] else "?" if node["o"] else ""
    return f"({text}){mark}" if mark else text


def _slots(node):
    """Whether a slot lies at ``node`` or below, outside of what is dropped or marked."""
    if node["l"][-1:] == "!":
        return False
    own = node["d"] != 1 and node["t"] == ["slot"]
    return own or any(_slots(c) for c in node["c"])


def plan(wrapper):
    """Where the main text lies: {"r": paths of regions, "p": path on other pages, "f": fixed texts,
    "v": paths of elements whose marks say nothing}.

    A host without any slot has only copies of a page, whose texts are then no template.
    """
    regions, fixed, totals, inner, marked = set(), set(), {}, {}, {}
    least_pages = LEAST_PAGES if _slots(wrapper) else float("inf")

    def known(node, pages):
        """Whether the text of ``node`` is fixed; ``pages`` are those of the nodes above it."""
        if not node["t"] or node["t"][0] != "fixed" or len(node["w"]) < least_pages:
            return False
        inside = 0 < node["g"] < len(pages)
        return node["p"] * 2 >= pages[node["g"]] if inside else node["p"] * 4 >= pages[0]

    def weigh(node, path, pages):
        """Characters of slots below ``node``, also of marked elements."""
        if path and path[-1][-2:] == "!!":
            return 0
        chars = 0
        if node["d"] != 1 and node["t"] and not known(node, pages) and node["k"] * 2 <= node["n"]:
            chars = node["n"]
        for child in node["c"]:
            chars += weigh(child, (*path, child["l"]), (*pages, child["p"]))
        if path and path[-1][-1] == "!":
            marked[path] = marked.get(path, 0) + chars
        return chars

    every = weigh(wrapper, (), (wrapper["p"],))
    void = {path for path, chars in marked.items() if chars * 2 > every}

    def walk(node, path, pages, drop):
        """Characters below ``node`` outside of regions, without fixed text; fills the tables."""
        chars = 0
        drop = drop or (path[-1:] and path[-1][-1] == "!" and path not in void)
        if not drop and node["d"] != 1:
            same = known(node, pages)
            if same:
                fixed.add(node["t"][2])
            if node["d"] == 2 and node["n"]:
                regions.add(path[: node["g"]])
            elif node["d"] == 0 and node["t"] and not same and node["k"] * 2 <= node["n"]:
                chars += node["n"]
        for child in node["c"]:
            chars += walk(child, (*path, child["l"]), (*pages, child["p"]), drop)
        if path and path not in totals:
            inner.setdefault(path[:-1], []).append(path)
        totals[path] = totals.get(path, 0) + chars
        return chars

    all_chars = walk(wrapper, (), (wrapper["p"],), False)
    path = ()
    while True:
        best = max(inner.get(path, ()), key=lambda p: (totals[p], p), default=None)
        if best is None or totals[best] < 0.7 * all_chars or re.split(r"[.!/]", best[-1])[0] in _CELLS:
            tables = {"r": regions, "f": fixed, "v": void}
            return {"p": list(path)} | {k: sorted(v) for k, v in tables.items()}
        path = best


def _kept(found, where, fixed):
    """The texts that ``where`` keeps of a page, or None if it says nothing about the page."""
    regions, void = set(map(tuple, where["r"])), set(map(tuple, where["v"]))
    sizes = sorted({len(p) for p in regions})
    path = tuple(where["p"])
    places = {}
    for block in found:
        if block[0] not in places:
            inside = any(block[0][:n] in regions for n in sizes)
            places[block[0]] = inside, _marked(block[0], void), block[0][: len(path)] == path
    own = lambda block: (
        not block[3] and not places[block[0]][1] and _key(block[0], block[1]) not in fixed
    )
    if any(places[block[0]][0] for block in found):
        return [block[1] for block in found if places[block[0]][0] and own(block)]
    rest = [
        x
        for x in found
        if places[x[0]][2] and not x[3] and not places[x[0]][1] and x[2] * 2 <= len(x[1])
    ]
    return [x[1] for x in rest if own(x)] if rest else None


def main_text(found, where):
    """The blocks of a page that are its article, joined by line breaks."""
    fixed = set(where["f"])
    kept = _kept(found, where, fixed)
    if kept is None:
        kept = _kept(found, plan(page_wrapper(found)), fixed)
    return "\n".join(kept or ())


# --- Spark ---------------------------------------------------------------------------------------


def _page_wrappers(batches):
    """(host, wrapper) of each page."""
    for batch in batches:
        found = [_written(page_wrapper(blocks(page))) for page in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.string())], ["host", "wrapper"]
        )


def _written(wrapper):
    return json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))


def _fold_runs(batches):
    """One (host, salt, wrapper) for each run of rows of one host and salt, folded in their order."""

    def rows():
        for batch in batches:
            host, salt, texts = batch.columns
            keys = zip(host.to_pylist(), salt.to_pylist(), strict=True)
            yield from ((*key, text.as_py()) for key, text in zip(keys, texts, strict=True))

    for (host, salt), run in groupby(rows(), key=lambda row: row[:2]):
        wrapper = functools.reduce(align, (json.loads(row[2]) for row in run))
        yield pa.RecordBatch.from_pydict(
            {
                "host": pa.array([host], pa.string()),
                "salt": pa.array([salt], pa.int64()),
                "wrapper": pa.array([_written(wrapper)], pa.string()),
            }
        )


def host_of(url):
    """The host of a URL column, the empty string without one."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def host_wrappers(pages, group=128, fan=32):
    """(host, wrapper) with one row per host, folded in groups of about ``group`` pages."""
    page = F.coalesce("html", F.lit(""))
    named = pages.select(host_of(F.col("url")).alias("host"), page.alias("wrapper"))
    most = named.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    salts = -(-most // group) or 1
    found = named.mapInArrow(_page_wrappers, "host string, wrapper string").select(
        "host",
        F.pmod(F.xxhash64("wrapper"), F.lit(salts)).alias("salt"),
        "wrapper",
        F.xxhash64("wrapper", F.lit(1)).alias("at"),
    )
    while True:
        found = (
            found.repartition("host", "salt")
            .sortWithinPartitions("host", "salt", "at", "wrapper")
            .select("host", "salt", "wrapper")
            .mapInArrow(_fold_runs, "host string, salt long, wrapper string")
        )
        if salts == 1:
            return found.select("host", "wrapper")
        salts = -(-salts // fan)
        up = F.floor(F.col("salt") / F.lit(fan))
        found = found.select("host", up.alias("salt"), "wrapper", F.col("salt").alias("at"))


def plans(wrappers):
    """(host, plan) as JSON."""

    def run(batches):
        for batch in batches:
            found = [json.dumps(plan(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string())], ["host", "plan"]
            )

    return wrappers.mapInArrow(run, "host string, plan string")


def extract(pages):
    """page_id, url, text and n_chars of each page."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    with_plan = attach(rows, plans(host_wrappers(pages)), ["host"], how="left")

    def run(batches):
        read = functools.lru_cache(4096)(json.loads)
        for batch in batches:
            texts = []
            for page, where in zip(
                batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
            ):
                found = blocks(page or "")
                where = read(where) if where else plan(page_wrapper(found))
                texts.append(main_text(found, where))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return with_plan.select("page_id", "url", "html", "plan").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
