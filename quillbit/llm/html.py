"""Main text of web pages, read along wrappers inferred for each host (union-free expressions).

A page becomes a tree of blocks and texts (inline tags are dropped, script and style
bodies skipped, missing end tags implied). Neighbours of one label fold into a repeated
group ``( )+``, and so do runs of labels that repeat (``h2 p h2 p`` is ``(h2 p)+``). The
trees of all pages of a host are aligned one after the other into its wrapper: equal
labels are matched in order, a stretch that only one side has becomes an optional group
``( )?``, texts that every page has stay template text, other texts are a slot. Every
task aligns the pages it meets; the wrappers of tasks are aligned in turn, in two rounds.
A wrapper has no whole texts and no page list, so its size follows a page's layout; where
pages name their blocks at random, groups that one page has are forgotten.

What the wrapper decides, once for a host:

* the article: groups of the tags ``article`` or ``main`` (or marked as such) that hold
  a tenth of the host's free text or more, else the group below which free text outside
  links comes together; free text is what is not template;
* template text in the article (an unmarked notice or subscribe line) is left out when
  ``EVIDENCE`` different pages have it and it is a small part of what they say; pages
  that share most of their text are copies and say nothing about templates. A heading
  that repeats stays if text follows that stays;
* tags and class words name menus, headers, footers, sidebars, notices, adverts, forms
  and comments; a group that holds the host's article is never left out for its class.

A page is read by aligning its own groups to the wrapper; groups that find no partner go
by the same names. Inside a block white space becomes one space; blocks are joined by a
line feed, in page order.

Defined results: null html counts as empty; a page without article text gives an empty
string; a page without a host belongs to host ``''``; repeated rows are read alike and
count as one page; elements nested deeper than ``DEPTH`` belong to their ancestor at that
depth and keep all text; a tag with broken quotes ends at its ``>``; extra columns are
ignored. Where alignments tie, the wrapper depends on the order in which pages meet.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.plans.storage import materialise, small_side

#: Different pages that must agree before text counts as template.
EVIDENCE = 3
#: Nesting that is kept as structure.
DEPTH = 60
#: Hosts whose wrappers a task holds before it sends them on, and shares of a host in the first merging round.
HELD, SHARES = 2000, 64
#: Children of a wrapper group beyond which those of one page alone are forgotten (pages that have them read them by name).
WIDTH = 200
#: Template texts up to this length are kept literally, longer ones by hash.
LITERAL = 80

#: Elements that begin a block, elements without content, raw text elements, elements that are never the article.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math canvas object audio video title".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog select option optgroup button".split())
#: Elements that name what follows them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption legend summary".split())
#: Class or id words that always name something beside the article, and class words that do so unless an article word stands by.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adv sponsor sponsored sidebar navbar nav navigation menu breadcrumb breadcrumbs footer "
    "masthead cookie cookies consent newsletter subscribe subscription comment comments reply replies respond popup modal pagination pager "
    "login signup toolbar".split()
)
WEAK = frozenset(
    "header promo promotion banner side notice notices alert share sharing social related recommended recommendations overlay widget search discussion".split()
)
ARTICLE_WORDS = frozenset("article articlebody story content body text post entry main results result".split())
ARTICLE = frozenset("article articlebody postbody entrycontent postcontent maincontent story articlecontent".split())
#: An open element of one of these is closed by a new one of the same group, up to the nearest of ``HOLDS``.
CLOSES = {t: g for g in (("li",), ("dd", "dt"), ("tr",), ("td", "th"), ("option",), ("p",)) for t in g}
HOLDS = frozenset("ul ol dl table article section div body".split())
UNFINISHED = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
#: A tag: quotes count only around a value, after an equals sign; an unclosed quote is part of an unquoted value; a ``<`` where
#: an attribute could begin ends a tag that lacks its ``>``.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/<>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|(?=<))",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORDS, DIGITS = re.compile(r"[^a-z0-9]+"), re.compile(r"[0-9]+")


def names(label: str) -> tuple[bool, bool]:
    """Whether a label names something beside the article, and whether its tag does, whatever its class."""
    tag, _, marks = label.partition(".")
    if tag in OUTSIDE:
        return True, True
    if not marks:
        return False, False
    classes, _, rest = marks.partition("#")
    own = {w for m in classes.split() for w in (m, *WORDS.split(m))}
    also = {w for m in rest.split() for w in (m, *WORDS.split(m))}
    if (own | also) & STRONG:
        return True, False
    return bool(own & WEAK and not own & ARTICLE_WORDS and tag != "section"), False


def is_article(label: str) -> bool:
    tag, _, marks = label.partition(".")
    if names(label)[0]:
        return False
    return tag in ("article", "main") or any(WORDS.sub("", m) in ARTICLE for m in marks.replace("#", " ").split())


class Group:
    """A group of a page or a wrapper.

    ``seen`` holds up to ``EVIDENCE`` digests of pages that have it, ``fixed`` the texts that
    all of them have (by key, with their length), ``chars`` and ``linked`` the characters
    met in it, also below, and in links there. On a page, ``items`` lists its texts.
    """

    __slots__ = ("chars", "children", "fixed", "items", "label", "linked", "optional", "pages", "repeat", "seen")

    def __init__(self, label: str):
        self.label, self.repeat, self.optional = label, False, False
        self.children: list[Group] = []
        self.seen: tuple[int, ...] = ()
        self.fixed: dict[str, int] = {}
        self.pages = self.chars = self.linked = 0
        self.items: list[tuple[int, str]] = []

    def pack(self) -> list:
        return [self.label, self.repeat, self.optional, self.seen, self.pages, self.chars, self.linked, self.fixed, [c.pack() for c in self.children]]

    @staticmethod
    def unpack(row: list) -> Group:
        out = Group(row[0])
        _, out.repeat, out.optional, seen, out.pages, out.chars, out.linked, out.fixed, children = row
        out.seen = tuple(seen)
        out.children = [Group.unpack(c) for c in children]
        return out

    def shape(self) -> frozenset[str]:
        return frozenset(c.label for c in self.children)

    def paths(self, deep: int = 3) -> set[str]:
        """Labels below, down to a depth, with the labels on their way."""
        return {c.label for c in self.children} | {f"{c.label}/{p}" for c in self.children for p in (c.paths(deep - 1) if deep > 1 else ())}

    def folds(self, other: Group) -> bool:
        """Whether two neighbours of one label look like repetitions: at least half of all that is below either is below both."""
        a, b = self.paths(), other.paths()
        return 2 * len(a & b) >= len(a | b)

    def free(self) -> int:
        """Characters that are not template, and not in links."""
        if self.label == "#text":
            return max(self.chars - self.linked - self.pages * self.template_chars(), 0)
        return sum(c.free() for c in self.children)

    def template_chars(self) -> int:
        return sum(self.fixed.values()) if len(self.seen) >= EVIDENCE else 0

    def template(self) -> int:
        return self.pages * self.template_chars() if self.label == "#text" else sum(c.template() for c in self.children)


def key_of(text: str) -> str:
    return text if len(text) <= LITERAL else f"\0{xxhash.xxh3_64_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def parse(html: str | None) -> Group:
    """The blocks of a page. Unknown and inline tags leave their text in the block around them."""
    html = html or ""
    root = Group("#root")
    stack: list[tuple[str, Group]] = [("#root", root)]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = hidden = number = 0
    in_link = False

    def put() -> None:
        nonlocal linked, number
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not hidden:
                leaf = Group("#text")
                leaf.items, leaf.chars, leaf.linked = [(number, text)], len(text), min(linked, len(text))
                leaf.fixed = {key_of(text): len(text)}
                stack[-1][1].children.append(leaf)
                number += 1
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal hidden
        put()
        for at in range(len(stack) - 1, depth - 1, -1):
            tag, _ = stack.pop()
            open_tags[tag] -= 1
            hidden -= at > DEPTH and tag in OUTSIDE

    def find(wanted, stop=frozenset()) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in wanted:
                return depth
            if stack[depth][0] in stop:
                break
        return 0

    at, end = 0, html.rfind(">") + 1
    while at < end:
        m = TOKEN.search(html, at, end)
        if not m:
            break
        text = html[at : m.start()]
        if text:
            parts.append(text)
            linked += len(text) * in_link
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            if m.group().startswith("<!--") and not m.group().endswith("-->"):
                at = len(html)
            continue
        if m.group(1):
            in_link = in_link and tag != "a"
            if open_tags[tag] > 0:
                close(find((tag,)))
            elif tag in BLOCKS:
                put()
            continue
        if tag in RAW:
            done = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            if not m.group(3).endswith("/") or done and tag not in ("svg", "math"):
                at = done.end() if done else len(html)
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                put()
            continue
        in_link = in_link or tag == "a"
        marks = _marks(m.group(3)) if m.group(3) else ""
        label = f"{tag}.{marks}" if marks else tag
        if tag in BLOCKS or marks and names(label)[0]:
            put()
            group = CLOSES.get(tag, ())
            depth = find(group, HOLDS) if any(open_tags[g] > 0 for g in group) else 0
            depth = depth or (find(("p",), HOLDS) if tag in BLOCKS and open_tags["p"] > 0 else 0)
            if depth:
                close(depth)
            node = stack[-1][1]
            if len(stack) <= DEPTH:
                node = Group(label)
                stack[-1][1].children.append(node)
            else:
                hidden += tag in OUTSIDE
            stack.append((tag, node))
            open_tags[tag] += 1
        elif open_tags[tag] > 0:  # inside a marked element of the same inline tag: its end tag is not that one's
            stack.append((tag, stack[-1][1]))
            open_tags[tag] += 1
    tail = UNFINISHED.search(html, at)
    parts.append(html[at : tail.start()] if tail else html[at:])
    put()
    return root


def _marks(attributes: str) -> str:
    """Class, role and itemprop words, then ``#`` and the id's that name something; digits count alike."""
    found = {"": [], "id": []}
    for a in ATTRIBUTE.finditer(attributes):
        value = DIGITS.sub("0", next(filter(None, a.groups()[1:]), "").lower())
        if a.group(1).lower() != "id":
            found[""].append(" ".join(value.split()))
        elif STRONG.intersection(WORDS.split(value)) or WORDS.sub("", value) in ARTICLE:
            found["id"].append(" ".join(value.split()))
    out = " ".join(filter(None, found[""]))
    return f"{out}#{' '.join(found['id'])}" if any(found["id"]) else out


def folded(page: Group, digest: int) -> Group:
    """A page as a wrapper of its own: repeats are folded, and every group has its page."""

    def mark(g: Group) -> None:
        g.pages, g.seen = 1, (digest,)
        g.children = _fold(g.children, mark)
        if g.label != "#text":
            g.chars = sum(c.chars for c in g.children)
            g.linked = sum(c.linked for c in g.children)

    mark(page)
    return page


def _fold(children: list[Group], mark) -> list[Group]:
    for c in children:
        mark(c)
    out: list[Group] = []
    for c in children:
        if out and out[-1].label == c.label and out[-1].folds(c):
            out[-1] = align(out[-1], c, same_page=True)
            out[-1].repeat = True
        else:
            out.append(c)
    # runs of two to four labels that repeat, and look alike, become one group
    for period in (2, 3, 4):
        labels = [c.label for c in out]
        at, rows = 0, []
        while at < len(out):
            run = labels[at : at + period]
            times = 1
            while (
                len(run) == period
                and labels[at + times * period : at + (times + 1) * period] == run
                and all(out[at + i].folds(out[at + times * period + i]) for i in range(period))
            ):
                times += 1
            if times == 1:
                rows.append(out[at])
                at += 1
                continue
            whole = None
            for i in range(times):
                one = Group("#" + "+".join(run))
                one.children = out[at + i * period : at + (i + 1) * period]
                one.pages, one.seen = one.children[0].pages, one.children[0].seen
                one.chars, one.linked = sum(c.chars for c in one.children), sum(c.linked for c in one.children)
                whole = one if whole is None else align(whole, one, same_page=True)
            whole.repeat = True
            rows.append(whole)
            at += times * period
        out = rows
    return out


Named = tuple[str, frozenset[str]]


def named(children: list[Group]) -> list[Named]:
    """Label and shape (labels of its own children) of each."""
    return [(c.label, c.shape()) for c in children]


def alike(a: frozenset[str], b: frozenset[str]) -> bool:
    """Whether the smaller of two shapes has half of its labels in the other."""
    return 2 * len(a & b) >= min(len(a), len(b)) if a and b else not a and not b


def matches(left: list[Named], right: list[Named]) -> list[tuple[bool, int, int, int, int]]:
    """The alignment of two sequences of blocks: stretches (equal or not, left from, to, right from, to), in n log n.

    The k-th of a label meets the k-th of it on the other side, of a label that repeats the k-th
    of one shape; of these pairs the longest run that rises on both sides is taken. Between
    them, blocks of one label are paired in order where their shapes are alike.
    """
    if len(left) == len(right) and all(x[0] == y[0] and (x[1] == y[1] or alike(x[1], y[1])) for x, y in zip(left, right, strict=True)):
        return [(True, 0, len(left), 0, len(right))]
    times = [Counter(label for label, _ in side) for side in (left, right)]

    def key(x: Named):
        return x if times[0][x[0]] > 1 or times[1][x[0]] > 1 else x[0]

    chain = _rising(list(map(key, left)), list(map(key, right)))
    out, i, j = [], 0, 0
    for x, y in [*chain, (len(left), len(right))]:
        for a, b in _between(left, right, i, x, j, y):
            out += [(False, i, a, j, b)] * (a > i or b > j) + [(True, a, a + 1, b, b + 1)]
            i, j = a + 1, b + 1
        if x > i or y > j:
            out.append((False, i, x, j, y))
        if x < len(left):
            out.append((True, x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def _rising(left: list, right: list) -> list[tuple[int, int]]:
    places: dict[object, list[int]] = defaultdict(list)
    for j, label in enumerate(right):
        places[label].append(j)
    used: Counter = Counter()
    pairs = []
    for i, label in enumerate(left):
        if used[label] < len(places.get(label, ())):
            pairs.append((i, places[label][used[label]]))
            used[label] += 1
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before[n] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [j], [n]
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def _between(left: list[Named], right: list[Named], i: int, x: int, j: int, y: int) -> Iterator[tuple[int, int]]:
    places: dict[str, list[int]] = defaultdict(list)
    for b in range(j, y):
        places[right[b][0]].append(b)
    for a in range(i, x):
        found = places.get(left[a][0], [])
        at = bisect_left(found, j)
        if at < len(found) and alike(left[a][1], right[found[at]][1]):
            yield a, found[at]
            j = found[at] + 1


def align(a: Group, b: Group, same_page: bool = False) -> Group:
    """The wrapper of two groups with one label. On one page texts add up (in ``a``); across pages template is what both have."""
    out = a if same_page else Group(a.label)
    out.repeat, out.optional = a.repeat or b.repeat, a.optional or b.optional
    out.chars, out.linked = a.chars + b.chars, a.linked + b.linked
    if same_page:
        out.pages = max(a.pages, b.pages)
        a.items += b.items
        a.fixed.update(b.fixed)
    else:
        out.pages = a.pages + b.pages
        out.seen = tuple(sorted({*a.seen, *b.seen})[:EVIDENCE])
        out.fixed = {k: n for k, n in a.fixed.items() if k in b.fixed}
    rows: list[Group] = []
    for equal, i, j, k, m in matches(named(a.children), named(b.children)):
        if equal:
            rows += [align(x, y, same_page) for x, y in zip(a.children[i:j], b.children[k:m], strict=True)]
        else:
            for c in (*a.children[i:j], *b.children[k:m]):
                c.optional = True
                rows.append(c)
    out.children = []
    for r in rows:
        last = out.children[-1] if out.children else None
        if last and last.label == r.label and (last.optional or r.optional) and last.folds(r):
            out.children[-1] = align(last, r, same_page)
            out.children[-1].repeat = True
        else:
            out.children.append(r)
    if len(out.children) > WIDTH and not same_page:
        out.children = [c for c in out.children if len(c.seen) > 1]
    return out


def infer(pages: list[str]) -> Group:
    """The wrapper of some pages of a host; equal pages count once."""
    wrapper = None
    for page in sorted(set(pages)):
        own = folded(parse(page), _digest(page))
        wrapper = own if wrapper is None else align(wrapper, own)
    return wrapper or Group("#root")


def _digest(page: str) -> int:
    return xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass"))


def expression(g: Group) -> str:
    """The wrapper as a union-free expression: ``( )+`` repeats, ``( )?`` may be missing, ``*`` is a slot."""
    if g.label == "#text":
        known = [k for k in g.fixed if not k.startswith("\0")]
        body = known[0] if len(g.fixed) == 1 and known and not g.repeat and g.pages * len(known[0]) == g.chars else "*"
    else:
        body = "".join(map(expression, g.children))
        if not g.label.startswith("#"):
            body = f"<{g.label}>{body}</{g.label.partition('.')[0]}>"
    if g.repeat:
        body = f"({body})+"
    return f"({body})?" if g.optional else body


#: What a group's rule says: go on, leave out, or read as article.
GO, SKIP, READ = 0, 1, 2


def rules(wrapper: Group) -> list:
    """The decisions for a host: nested [label, rule, template keys, children, shape]."""
    total = wrapper.free()

    def marked(g: Group) -> bool:
        """Whether a group is left out by its name; one that holds an article, or nearly all the host says, is not."""
        beside, by_tag = names(g.label)
        if not beside or by_tag:
            return beside
        return not (any(map(holds_article, g.children)) or 20 * g.free() >= 19 * total > 0)

    def holds_article(g: Group) -> bool:
        if names(g.label)[0]:
            return False
        return g.label.partition(".")[0] in ("article", "main") or any(map(holds_article, g.children))

    def is_header(g: Group) -> bool:
        return g.label.partition(".")[0] == "header"

    roots: list[Group] = []

    def search(g: Group) -> None:
        for c in g.children:
            if not marked(c) and not is_header(c):
                if is_article(c.label):
                    roots.append(c)
                else:
                    search(c)

    search(wrapper)
    found = sum(r.free() for r in roots)
    kept = {id(r) for r in roots}
    if not roots or len(wrapper.seen) >= EVIDENCE and 10 * found < _mass(wrapper, marked):
        kept = {id(_densest(wrapper, marked))}

    def out(g: Group, inside: bool, drop: bool) -> list:
        begins = id(g) in kept
        if begins:
            inside = True
            share = g.template()
            drop = 0 < 3 * share <= max(g.chars - share, 0)
        rule = READ if begins else GO
        if not begins and g is not wrapper and (marked(g) or is_header(g) and not inside):
            return [g.label, SKIP, [], [], sorted(g.shape())]
        template = sorted(g.fixed) if g.label == "#text" and inside and drop and len(g.seen) >= EVIDENCE else []
        return [g.label, rule, template, [out(c, inside, drop) for c in g.children], sorted(g.shape())]

    return out(wrapper, False, False)


def _mass(g: Group, marked) -> int:
    if g.label == "#text":
        return g.free()
    return sum(_mass(c, marked) for c in g.children if not marked(c))


def _densest(wrapper: Group, marked) -> Group:
    """The deepest group on the way down along which most free text stays together."""
    at = wrapper
    while True:
        inner = [c for c in at.children if c.label != "#text" and not marked(c) and c.label.partition(".")[0] != "header"]
        best = max(inner, key=lambda c: _mass(c, marked), default=None)
        if best is None or best.repeat or best.label.startswith("#"):
            return at
        tag = best.label.partition(".")[0]
        if tag not in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center") or 10 * _mass(best, marked) < 7 * _mass(at, marked):
            return at
        at = best


def main_text(html: str | None, found: list | None = None) -> str:
    """The article of a page, read along the rules of its host (none: those of the page alone)."""
    page = folded(parse(html), 0)
    found = found or rules(page)
    kept: list[tuple[int, str, bool, bool]] = []

    def take(g: Group, template, heading: bool) -> None:
        kept.extend((n, t, heading, key_of(t) in template) for n, t in g.items)

    def default(g: Group, inside: bool, heading: bool) -> None:
        """Groups that the wrapper has not met."""
        if g.label == "#text":
            if inside:
                take(g, (), heading)
            return
        tag = g.label.partition(".")[0]
        if names(g.label)[0] or tag == "header" and not inside:
            return
        inside = inside or is_article(g.label)
        for c in g.children:
            default(c, inside, tag in HEADINGS)

    def read(g: Group, rule: list, inside: bool, heading: bool) -> None:
        if rule[1] == SKIP:
            return
        inside = inside or rule[1] == READ
        if g.label == "#text":
            if inside:
                take(g, frozenset(rule[2]), heading)
            return
        heading = g.label.partition(".")[0] in HEADINGS
        for equal, i, j, k, m in matches(named(g.children), [(c[0], frozenset(c[4])) for c in rule[3]]):
            if equal:
                for c, r in zip(g.children[i:j], rule[3][k:m], strict=True):
                    read(c, r, inside, heading)
            else:
                for c in g.children[i:j]:
                    default(c, inside, heading)

    read(page, found, False, False)
    kept.sort()
    blocks: list[str] = []
    for i, (_, text, heading, template) in enumerate(kept):
        if not template or heading and i + 1 < len(kept) and not kept[i + 1][3]:
            blocks.append(text)
    return "\n".join(blocks)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _dump(g: Group) -> str:
    return json.dumps(g.pack(), ensure_ascii=False, separators=(",", ":"))


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The wrappers of the pages of one task, by host."""
    held: dict[str, Group] = {}

    def sent() -> pd.DataFrame:
        out = pd.DataFrame([(h, _dump(g)) for h, g in held.items()], columns=["host", "wrapper"])
        held.clear()
        return out

    for frame in frames:
        for host, page in zip(frame["host"], frame["html"], strict=True):
            own = folded(parse(page), _digest(page))
            held[host] = align(held[host], own) if host in held else own
            if len(held) > HELD:
                yield sent()
    yield sent()


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by host: one wrapper at a time."""
    host, wrapper = None, None
    for frame in frames:
        for name, text in zip(frame["host"], frame["wrapper"], strict=True):
            own = Group.unpack(json.loads(text))
            if name == host:
                wrapper = align(wrapper, own)
                continue
            if wrapper is not None:
                yield pd.DataFrame([(host, _dump(wrapper))], columns=["host", "wrapper"])
            host, wrapper = name, own
    if wrapper is not None:
        yield pd.DataFrame([(host, _dump(wrapper))], columns=["host", "wrapper"])


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, rules) for every host, from all its pages."""
    keyed = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = "host string, wrapper string"
    share = F.pmod(F.xxhash64("wrapper"), F.lit(SHARES))
    first = keyed.mapInPandas(_partial, kind).repartition("host", share).sortWithinPartitions("host", "wrapper").mapInPandas(_joined, kind)
    whole = first.repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(_joined, kind)

    @F.pandas_udf("wrapper string, rules string")
    def decided(texts: pd.Series) -> pd.DataFrame:
        found = [Group.unpack(json.loads(t)) for t in texts]
        return pd.DataFrame([(expression(g), json.dumps(rules(g), ensure_ascii=False)) for g in found], columns=["wrapper", "rules"])

    return whole.select("host", decided("wrapper").alias("w")).select("host", "w.wrapper", "w.rules")


def extract(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, url, text) for every page."""
    found = materialise(wrappers(pages, url, html).select("host", "rules"), "wrappers")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, list] = {}
        for bodies, texts in batches:
            out = []
            for body, text in zip(bodies, texts, strict=True):
                if text not in known:
                    if len(known) > HELD:
                        known.clear()
                    known[text] = json.loads(text) if text else None
                out.append(main_text(body, known[text]))
            yield pd.Series(out)

    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(html).alias("__html"), host_of(F.col(url)).alias("host"))
    joined = rows.join(small_side(found), "host", "left")
    return joined.select(F.col("__key").alias(key), F.col("__url").alias("url"), read("__html", "rules").alias("text"))
