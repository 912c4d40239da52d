"""Main text of web pages by wrapper induction: union-free regular expressions over token streams.

A page is a stream of tags and texts, held as a tree: inline tags don't count, repeated siblings fold into a
repeated group. The pages of a host are aligned one after the other with the host's wrapper: what differs in text
becomes a text slot, what only one side has becomes an optional group, a repeated group takes single and
repeated occurrences. Wrappers of batches of pages merge to wrappers of more, in rounds, until each template of a host has one
(pages with an article or main region, pages whose region lies in something other than content, pages without a region);
merging is by pages in any number, so a host with a third of all pages is merged in many tasks.
In the wrapper, slots are told apart once for all its pages: those in menus, headers, footers, sidebars, notices,
adverts, forms and comments (by tag, role, class and id) are not content, nor are texts that are the same on all pages while others differ;
if there is an article or main region, content lies there, otherwise in the smallest group that holds most of the text. A
page is then aligned with the wrapper, and its texts in content slots are joined.

Defined cases: null and empty html give the empty text; a page whose URL is null or names no host is alone, //host/ names one; a page that is alone on
its host, or whose host's pages are all alike, has no text that can be told as constant; html of any length is read whole,
broken markup as far as it goes; repeated rows are extracted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import written

#: Wrappers that one task merges, about.
FAN_IN = 32
#: Wrappers of all hosts are broadcast up to so many bytes; beyond, they join by host.
BROADCAST_BYTES = 32 << 20
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style template noscript textarea iframe svg math object canvas select button title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table tbody div section article main body".split())
#: Tags whose runs are one repeated group whatever is inside.
ITEMS = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 option blockquote pre figure #".split())
NOT_CONTENT = frozenset("nav footer aside form head script style dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id that tell what isn't the article.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets "
    "footer header masthead topbar cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup signin login comment comments reply replies respond "
    "disqus share sharing social related recommended recommendations pagination pager disclaimer search toolbar skip hidden".split()
)
#: Elements below this depth are nodes only if they are the outermost that hide their text or bound a region; texts keep their place.
DEPTH = 150
#: Steps of an alignment.
BOTH, OF_A, OF_B = range(3)
NOTHING: frozenset[str] = frozenset()
#: Those of WORDS that hold for an article element itself.
OF_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser".split())
_ABOUT = ("has-", "with-", "no-", "without-", "is-")
_token = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.S)
#: The same for markup with a quote that never ends: quotes don't count, and a tag ends before the next one begins.
_broken = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>|[^<]+|<""", re.S)
_attribute = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_word = re.compile(r"[a-z]+")


def key_of(tag: str, attributes: str, inside: bool = False) -> tuple[str, bool]:
    """The token of a start tag, its name with the words of its class, id and role; whether it starts something other than content.

    What isn't content has a token of its own, so that a hidden element never aligns with a visible one.
    inside: whether it stands in an article or main region, where a header belongs to the text. A class that says what a
    page has or lacks ("with-sidebar") says nothing of this element.
    """
    words, off = [], tag in NOT_CONTENT or (tag == "header" and not inside)
    telling = {"html": NOTHING, "body": NOTHING, "main": NOTHING, "article": OF_ARTICLES}.get(tag, WORDS)
    if attributes.strip(" /\n\t\r"):
        for name, value in _attribute.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                words += _word.findall(value)
                own = {w for part in value.split() if not part.startswith(_ABOUT) for w in _word.findall(part)}
                off = off or any(w in telling and not (inside and w == "header") for w in own)
            elif name == "role":
                words.append("role" + value)
                off = off or value in ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                off = True
    return ".".join([tag, *words[:6], *["!"] * off]), off


class Node:
    """kind: '#' a text, or the token of a tag. many: a repeated group. rare: optional. seen: pages, chars: their characters."""

    __slots__ = ("kind", "kids", "many", "rare", "off", "mark", "seen", "chars", "texts", "content")

    def __init__(self, kind, off=False):
        self.kind, self.off, self.kids, self.many, self.rare = kind, off, [], False, False
        self.mark, self.seen, self.chars, self.texts, self.content = None, 1, 0, [], False


def tokens_of(source: str):
    """Matches of tags, comments and texts, in time that grows with the length: after the first tag without an end quotes don't count."""
    pattern, at = _token, 0
    while at < len(source):
        m = pattern.match(source, at)
        if pattern is _token and m[0] == "<" and re.match(r"/?[a-zA-Z]", source[at + 1 : at + 3]):
            pattern = _broken
            continue
        yield m
        at = m.end()


def parse(source: str | None) -> Node:
    """The tree of a page; texts are decoded and hold (position in the page, text)."""
    root = Node("page")
    # open elements: tag, node that takes what is inside, its depth, whether it hides its text, whether a region or article holds it
    stack: list[tuple[str, Node, int, bool, bool, bool]] = [("page", root, 0, False, False, False)]
    opened: dict[str, int] = {}
    buffer: list[str] = []
    count = 0
    raw = None

    def flush():
        nonlocal count
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                leaf = Node("#")
                leaf.texts, leaf.chars, leaf.mark = [(count, text)], len(text), zlib.crc32(text.encode())
                stack[-1][1].kids.append(leaf)
                count += 1

    def close(k):
        for entry in stack[k:]:
            opened[entry[0]] -= 1
        del stack[k:]

    for m in tokens_of(source or ""):
        token, tag = m[0], m[2]
        if raw is not None:  # inside a script and the like: only its own end counts
            if tag and m[1] and tag.lower() == raw:
                raw = None
            continue
        if not tag:
            if token[0] != "<" or token == "<":
                buffer.append(token)
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                raw = tag
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag doesn't end the region
            continue
        if tag != "body" and tag != "html" and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in CLOSES and any(opened.get(t) for t in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in FENCE:
                    break
        _, parent, depth, hidden, within, inside = stack[-1]
        key, off = key_of(tag, m[3], inside)
        node = Node(key, off)
        region = regional(node)
        if depth < DEPTH or (off and not hidden) or (region and not within):
            parent.kids.append(node)
            parent, depth = node, depth + 1
        if not m[3].endswith("/"):
            stack.append((tag, parent, depth, hidden or off, within or region, inside or tag in ("article", "main")))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    fold(root)
    return root


def fold(node: Node) -> str:
    """Runs of siblings of one structure, and of list items and the like, become one repeated group; returns the node's structure."""
    kids: list[Node] = []
    shapes: list[str] = []
    for k in node.kids:
        own = fold(k)
        if kids and kids[-1].kind == k.kind and (own == shapes[-1] or k.kind.split(".")[0] in ITEMS):
            merge(kids[-1], k, same_page=True)
            kids[-1].many = True
        else:
            kids.append(k)
            shapes.append(own)
    node.kids = kids
    return "#" if node.kind == "#" else f"<{node.kind}>{''.join(shapes)}</>"


def shape(node: Node) -> tuple[str, frozenset[str]]:
    return node.kind, frozenset(k.kind for k in node.kids)


def aligned(a: list[Node], b: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Both lists in order, equal tokens matched by a longest common subsequence, like ones first: one rule for lists of any length."""
    if [x.kind for x in a] == [x.kind for x in b]:
        return list(zip(a, b, strict=True))
    out: list[tuple[Node | None, Node | None]] = []
    x, y = iter(a), iter(b)
    for step in _steps(list(map(shape, a)), list(map(shape, b))):
        out.append((None if step == OF_B else next(x), None if step == OF_A else next(y)))
    return out


def _steps(x: list, y: list):
    """BOTH, OF_A or OF_B for each step of the alignment of two lists of shapes.

    A pair counts 3 if what is inside begins alike, 2 if it has a token in common, else 1. best[i][j] is the most that x[i:] and y[j:] can count;
    a step takes a pair if that is best, otherwise leaves one of x if that loses nothing, otherwise one of y.
    """
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:  # none could count more
        yield BOTH
        start += 1
    x, y = x[start:], y[start:]
    places: dict[str, dict[frozenset, list[int]]] = {}
    for j, (kind, inside) in enumerate(y):
        places.setdefault(kind, {}).setdefault(inside, []).append(j)
    most = {s: max((_count(s[1], inside) for inside in places.get(s[0], ())), default=0) for s in set(x)}
    paired = [i for i, s in enumerate(x) if most[s]]  # the others are left as soon as they are met
    i = j = k = 0
    for step in _path([x[p] for p in paired], len(y), places, [most[x[p]] for p in paired]):
        yield from [OF_A] * (paired[k] - i)
        i = paired[k]
        yield step
        if step != OF_B:
            i, k = i + 1, k + 1
        j += step != OF_A
    yield from [OF_A] * (len(x) - i)
    yield from [OF_B] * (len(y) - j)


def _count(a: frozenset[str], b: frozenset[str]) -> int:
    return 3 if a == b else 2 if a & b else 1


def _path(x: list, m: int, places: dict, most: list[int]):
    """The steps until all of x is passed; places: where each shape stands in the other list of m, most: what each of x counts at most.

    best is made in a band around the diagonal, which grows until no path that leaves it can count as much; rows stand in memory
    for one block of x at a time and once for each block.
    """
    n = len(x)
    counts: dict[tuple, np.ndarray] = {}
    lost, total = np.cumsum(sorted(most)), sum(most)
    size, width = max(64, 2 * isqrt(n)), 16
    never = np.int32(-(1 << 30))

    def count(s):
        if s not in counts:
            if len(counts) * m > 1 << 23:
                counts.clear()
            counts[s] = np.zeros(m + 1, np.int32)
            for inside, at in places[s[0]].items():
                counts[s][at] = _count(s[1], inside)
        return counts[s]

    def rows(row, low, high, steps=None):
        """From best[high] to best[low], in place; steps: for each i the first j of the band, and from there on 1 for a pair, 2 if leaving x[i] loses nothing."""
        for i in range(high - 1, low - 1, -1):
            first, end = max(0, i + left), min(m, i + right) + 1
            own = count(x[i])[first:end]
            pair = row[first + 1 : end + 1] + own
            best = np.maximum.accumulate(np.maximum(row[first:end], pair)[::-1])[::-1]
            if steps is not None:
                steps[i] = first, ((best == pair) & (own > 0)) + 2 * (row[first:end] >= np.append(best[1:], never)).astype(np.int8)
            row[first:end] = best
            row[end : end + 1] = never

    while n:
        left, right = min(0, m - n) - width, max(0, m - n) + width
        row, held, steps = np.full(m + 2, never), {}, {}
        row[max(0, n + left) : m + 1] = 0
        for low in range((n - 1) // size * size, -1, -size):
            held[low] = row.copy() if low else None
            rows(row, low, min(n, low + size), None if low else steps)
        leave = width + 1 + max(0, n - m)  # so many of x a path outside the band leaves at least
        if leave > n or total - lost[leave - 1] < row[0]:
            break
        width *= 4
    j = 0
    for i in range(n):
        if i not in steps:
            steps.clear()
            rows(held.pop(i), i, min(n, i + size), steps)
        first, codes = steps[i]
        while not (code := int(codes[j - first])):
            yield OF_B
            j += 1
        yield BOTH if code & 1 else OF_A
        j += code & 1


def merge(a: Node, b: Node, *, same_page: bool = False) -> Node:
    """a becomes the wrapper of both."""
    a.seen += 0 if same_page else b.seen
    a.chars += b.chars
    a.many, a.rare, a.off = a.many or b.many, a.rare or b.rare, a.off or b.off
    if a.kind == "#":
        if a.mark != b.mark:
            a.mark = None  # a slot
        a.texts += b.texts
        return a
    kids = []
    for x, y in aligned(a.kids, b.kids):
        if x is not None and y is not None:
            kids.append(merge(x, y, same_page=same_page))
        else:
            kids.append(x or y)
            kids[-1].rare = True
    a.kids = kids
    return a


def dump(node: Node) -> list:
    return [node.kind, int(node.many), int(node.rare), int(node.off), node.mark, node.seen, node.chars, int(node.content), [dump(k) for k in node.kids]]


def load(data: list) -> Node:
    node = Node(data[0], bool(data[3]))
    node.many, node.rare, node.mark, node.seen, node.chars, node.content = bool(data[1]), bool(data[2]), data[4], data[5], data[6], bool(data[7])
    node.kids = [load(k) for k in data[8]]
    return node


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tokens, for people."""
    inner = ("#PCDATA" if node.mark is None else "text") if node.kind == "#" else f"<{node.kind}>{' '.join(map(expression, node.kids))}</{node.kind}>"
    return f"({inner})+" if node.many else f"({inner})?" if node.rare else inner


def leaves(node: Node, path=()):
    if node.kind == "#":
        yield node, path
    for k in node.kids:
        yield from leaves(k, (*path, node))


def regional(n: Node) -> bool:
    return n.kind.split(".")[0] in ("article", "main") or "rolemain" in n.kind.split(".")


def regions(found: list) -> tuple[list[Node], int]:
    """The leaves in an article or main region; the template: 2 with such leaves, 1 if all lie in what isn't content, 0 without."""
    if region := [leaf for leaf, path in found if any(map(regional, path)) and not any(n.off for n in path)]:
        return region, 2
    # what holds the region may bear a telling class by mistake: then only what is inside it counts
    within = [(leaf, path[next(k for k, n in enumerate(path) if regional(n)) :]) for leaf, path in found if any(map(regional, path))]
    region = [leaf for leaf, path in within if not any(n.off for n in path)]
    return region, int(bool(region))


def template(page: Node) -> int:
    return regions(list(leaves(page)))[1]


def label(root: Node) -> Node:
    """Marks the content slots of a wrapper."""
    found = list(leaves(root))
    for leaf, _ in found:
        leaf.content = False
    varies = any(leaf.mark is None for leaf, path in found)
    inside = [(leaf, path) for leaf, path in found if not any(n.off for n in path)]
    region, _ = regions(found)
    if region:
        for leaf in region:
            leaf.content = True
        return root
    # without a region: texts that are the same on all of several pages are the host's, not the page's
    inside = [(leaf, path) for leaf, path in inside if not (varies and leaf.mark is not None and leaf.seen == root.seen >= 3)]
    total = sum(leaf.chars for leaf, _ in inside)
    groups: dict[int, list] = {}
    for leaf, path in inside:
        for depth, n in enumerate(path):
            g = groups.setdefault(id(n), [depth, 0, []])
            g[1] += leaf.chars
            g[2].append(leaf)
    if groups:
        smallest = max((g for g in groups.values() if 10 * g[1] >= 7 * total), key=lambda g: g[0])
        if len(smallest[2]) == 1:  # one slot: what stands beside it in its parent (a heading) belongs to it
            smallest = max((g for g in groups.values() if 10 * g[1] >= 7 * total and g[0] < smallest[0]), key=lambda g: g[0], default=smallest)
        for leaf in smallest[2]:
            leaf.content = True
    return root


def extract(page: Node, wrapper: Node) -> str:
    """The page's texts in content slots, in page order."""
    out: list[tuple[int, str]] = []
    todo = [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        if w.kind == "#":
            if w.content:
                out += p.texts
            continue
        todo += [(x, y) for x, y in aligned(w.kids, p.kids) if x is not None and y is not None]
    return " ".join(t for _, t in sorted(out))


def induced(pages: list[Node]) -> Node:
    """The wrapper of some pages or wrappers."""
    first, *rest = pages
    for p in rest:
        merge(first, p)
    return first


def _stripped(node: Node) -> Node:
    for leaf, _ in leaves(node):
        leaf.texts = []
    return node


def host_of(column):
    return F.lower(F.coalesce(F.regexp_extract(column, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON: for each template its wrapper, slots labelled): all pages of a host take part, but those of no host."""

    def read(batches):
        for batch in batches:
            by: dict[tuple[str, int], Node] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = _stripped(parse(source))
                key = (host, template(page))
                by[key] = merge(by[key], page) if key in by else page
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in by], pa.string()), pa.array([t for _, t in by], pa.int32()), pa.array([json.dumps(dump(w)) for w in by.values()], pa.string())], ["host", "template", "wrapper"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        merged = induced([load(json.loads(w)) for w in sorted(group["wrapper"])])
        return pd.DataFrame({"host": group["host"][:1], "template": group["template"][:1], "wrapper": [json.dumps(dump(merged))]})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        by = {str(t): dump(label(load(json.loads(w)))) for t, w in zip(group["template"], group["wrapper"], strict=True)}
        return pd.DataFrame({"host": group["host"][:1], "wrapper": [json.dumps(by)]})

    schema = "host string, template int, wrapper string"
    rows = written(pages.select(host_of("url").alias("host"), "html").where("host <> ''").mapInArrow(read, schema), "wrappers")
    while True:
        counts = rows.groupBy("host", "template").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return written(rows.groupBy("host").applyInPandas(finish, "host string, wrapper string"), "wrappers")
        if most <= FAN_IN:
            rows = written(rows.groupBy("host", "template").applyInPandas(join, schema), "wrappers")
        else:
            dealt = rows.join(counts, ["host", "template"]).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN_IN)))
            dealt = dealt.withColumn("part", F.when(F.col("n") > FAN_IN, F.col("part")).otherwise(F.lit(0)))
            rows = written(dealt.groupBy("host", "template", "part").applyInPandas(join, schema), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    found = wrappers(pages)
    size = found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    held = F.broadcast(found) if size <= BROADCAST_BYTES else found
    kinds = dict(pages.dtypes)

    def run(batches):
        known: dict[str, dict[str, Node]] = {}
        for batch in batches:
            texts = []
            for host, wrapper, source in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = parse(source)
                if wrapper is None:  # no host: the page is alone
                    texts.append(extract(page, label(page)))
                    continue
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = {t: load(w) for t, w in json.loads(wrapper).items()}
                texts.append(extract(page, known[host][str(template(page))]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", host_of("url").alias("host")).join(held, "host", "left")
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
