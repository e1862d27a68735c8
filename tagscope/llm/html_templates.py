"""HTML main-text extraction by equivalence-class template deduction.

Pages of one host come from few templates.  In a group of same-host pages every
token (tag with its class and id, or a whole text chunk) has an occurrence
vector: how often it occurs on each page.  Tokens with equal vectors form an
equivalence class.  A class is valid when its tokens keep their order on every
page and, for classes that repeat, when all its occurrences lie in one slot of
the class around it.  The class that occurs once on every page is the skeleton;
between its neighbouring tokens lie slots, into which the other valid classes
are nested.  Page furniture is left out, and so are slots that hold mostly links
or lie outside the slots that vary; an element marked as furniture that encloses
the main text is none, and only furniture deeper in it is left out.  An article or main element is one feature
of a slot: what lies in it stays, and it is the only main text where it holds
the bulk of the varying text on the pages built like this one; elsewhere the
slots around it stay too.  The whole text of what remains is extracted, repeated
passages included.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_HOSTS = 1_000_000   # large hosts (name and number) that are broadcast at most; beyond, the join shuffles
GROUP_PAGES = 48      # pages that are deduced together, about; larger hosts are dealt to several groups

# HTML element kinds.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "canvas", "title", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
                    "strike strong sub sup time tt u var wbr").split())
MAIN = frozenset(("article", "main"))
UNCLOSED = frozenset("p li dt dd tr td th option".split())      # often left open: no part of a path
FURNITURE = frozenset("head nav header footer aside form button dialog menu fieldset".split())
FURNITURE_NAMES = frozenset((
    "ad ads advert adverts advertisement advertising sponsored sponsor promo banner sidebar aside nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs header masthead footer comment comments respond reply replies disqus cookie cookies consent "
    "notice notices gdpr popup modal newsletter subscribe subscription signup share sharing social related recommended widget "
    "toolbar pagination pager alert").split())
COMMENT_NAMES = frozenset("comment comments respond reply replies disqus".split())
WRAPPERS = frozenset(("form", "dialog", "fieldset", "header"))      # furniture by name that can also stand around a whole page
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*>", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass(slots=True)
class Token:
    kind: str            # open, close, text
    name: str            # element name, or the text as written
    role: str            # what tells it apart from other tokens
    furniture: tuple = ()        # what marks it as furniture: name, role, words of class and id


def tokens(page: str) -> list[Token]:
    """Tags and text chunks in page order; comments, declarations and raw
    elements are gone."""
    out: list[Token] = []
    at = 0

    def text(chunk: str) -> None:
        if chunk:
            out.append(Token("text", chunk, "T" + " ".join(chunk.split())))

    for m in TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = m.group("name")
        if not name:
            continue
        name = name.lower()
        if m.group("end"):
            out.append(Token("close", name, "/" + name))
            continue
        marks = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTR.findall(m.group("attrs"))} if "=" in m.group("attrs") else {}
        words = set(re.split(r"[^a-z]+", marks.get("class", "") + " " + marks.get("id", "")))
        furniture = name in FURNITURE or marks.get("role", "") in FURNITURE_ROLES or (
            name not in MAIN and name not in ("html", "body") and bool(words & FURNITURE_NAMES))
        mark = (name, marks.get("role", ""), frozenset(words)) if furniture else ()
        role = f"{name} {marks['class']}" if "class" in marks else name
        out.append(Token("open", name, role, mark))
        if name in VOID or m.group("attrs").endswith("/") and name in ("path", "use"):
            out[-1].kind = "void"
    text(page[at:])
    return out


@dataclass
class Template:
    """Skeleton roles in page order; slot i lies before skeleton token i (the
    last slot after all).  ``nested``: classes found inside each slot."""
    skeleton: list[str]
    main: list[bool] = field(default_factory=list)
    nested: dict[int, list[frozenset]] = field(default_factory=dict)
    articles: dict[frozenset, str] = field(default_factory=dict)    # by build of a page: "only", "some" or "links"
    wrappers: frozenset = frozenset()       # elements that enclose the main text: their furniture marks, from outside to inside


def element_ends(page: list[Token]) -> dict[int, int]:
    """Index after each furniture, article and main element, by where it opens;
    one that is never closed ends at the next block-level tag (furniture) or
    with the page."""
    names = {t.name for t in page if t.kind == "open" and (t.furniture or t.name in MAIN)}
    opened: dict[str, list[int]] = {name: [] for name in names}
    ends: dict[int, int] = {}
    for i, t in enumerate(page):
        if t.name in names:
            if t.kind == "open":
                opened[t.name].append(i)
            elif t.kind == "close" and opened[t.name]:
                ends[opened[t.name].pop()] = i + 1
    left = {i for places in opened.values() for i in places}
    stop = len(page)
    for i in range(len(page) - 1, -1, -1) if left else ():
        t = page[i]
        if i in left:
            ends[i] = stop if t.furniture else len(page)
        if t.kind in ("open", "close") and t.name not in INLINE:
            stop = i
    return ends


class Around:
    """The wrappers around a place that moves on through a page."""

    def __init__(self, ends: dict[int, int], wrappers: set | frozenset):
        self.ends, self.wrappers = ends, wrappers
        self.open: list[tuple[int, tuple]] = [(math.inf, ())]

    def enter(self, i: int, mark: tuple) -> bool:
        """Whether the furniture that opens at ``i`` is a wrapper."""
        while self.open[-1][0] <= i:
            self.open.pop()
        self.chain = (*self.open[-1][1], mark)
        if self.chain in self.wrappers:
            self.open.append((self.ends[i], self.chain))
            return True
        return False


@dataclass
class Outline:
    """Of one page: which tokens lie in furniture, which in an article, the
    paths of its outermost articles (its build) and how many these are."""
    hidden: bytearray
    article: bytearray
    build: frozenset
    n_articles: int


def outline(page: list[Token], ends: dict[int, int], wrappers: set | frozenset) -> Outline:
    hidden, article = bytearray(len(page)), bytearray(len(page))
    paths, n, depth, skip = set(), 0, 0, 0
    stack: list[Token] = []
    inside: Counter = Counter()      # names in the stack
    around = Around(ends, wrappers)
    for i, t in enumerate(page):
        if i < skip:
            hidden[i] = 1
            continue
        if t.kind == "open" and t.furniture and not around.enter(i, t.furniture):
            skip = ends[i]
            hidden[i] = 1
            continue
        if t.kind in ("open", "close"):
            if t.name in MAIN:
                if t.kind == "open" and not depth:
                    paths.add("/".join(x.role for x in (*stack, t)))
                    n += 1
                depth = max(0, depth + (1 if t.kind == "open" else -1))
            if t.name not in INLINE and t.name not in UNCLOSED:
                if t.kind == "open":
                    stack.append(t)
                    inside[t.name] += 1
                while t.kind == "close" and inside[t.name]:
                    inside[(last := stack.pop()).name] -= 1
                    if last.name == t.name:
                        break
        article[i] = depth > 0
    return Outline(hidden, article, frozenset(paths), n)


def varying_text(pages: list[list[Token]], counts: list[Counter]) -> list[list[int]]:
    """Per token, the length of a text outside links that is not the same on
    every page; of every text if none varies."""
    def lengths(same: set) -> list[list[int]]:
        out = []
        for page in pages:
            link, own = 0, []
            for t in page:
                if t.name == "a" and t.kind != "text":
                    link = t.kind == "open"
                own.append(len(t.role) - 1 if t.kind == "text" and not link and t.role not in same else 0)
            out.append(own)
        return out

    same = {r for r, n in counts[0].items() if all(c.get(r) == n for c in counts[1:])} if len(pages) > 1 else set()
    found = lengths(same)
    return found if any(map(any, found)) else lengths(set())


def may_wrap(mark: tuple) -> bool:
    """Furniture by a name or class that can also stand around a whole page."""
    name, role, words = mark
    if name in FURNITURE or role in FURNITURE_ROLES:
        return name in WRAPPERS or name not in FURNITURE and role in WRAPPERS
    return bool(words - FURNITURE_NAMES - {""})


def find_wrappers(pages: list[list[Token]], ends: list[dict[int, int]], weights: list[list[int]]) -> frozenset:
    """Marks of furniture that encloses the main text, from outside to inside.
    On the pages with such an element, an article in it holds more varying text
    than all that is in no furniture, and half of the element's or more; or the
    element holds most of the page's varying text, with less than a tenth of it
    in no furniture."""
    sums = [[0, *accumulate(w)] for w in weights]
    wrappers: set = set()
    while True:
        own, biggest, outside, total = Counter(), Counter(), Counter(), Counter()
        for page, end, run in zip(pages, ends, sums):
            found: dict[tuple, list[int]] = {}
            hidden, skip, around = 0, 0, Around(end, wrappers)
            for i in sorted(end):
                t = page[i]
                if i < skip:
                    if t.name in MAIN:
                        was = found[around.chain]
                        was[1] = max(was[1], run[min(end[i], skip)] - run[i])
                elif t.furniture and not around.enter(i, t.furniture):
                    skip = end[i]
                    hidden += run[skip] - run[i]
                    found.setdefault(around.chain, [0, 0])[0] += run[skip] - run[i]
            for key, (held, article) in found.items():
                own[key] += held
                biggest[key] += article
                outside[key] += run[-1] - hidden
                total[key] += run[-1]

        def encloses_main(key: tuple) -> bool:
            if key[-1][2] & COMMENT_NAMES and outside[key]:
                return False
            bulk = 2 * own[key] > total[key] and 10 * outside[key] < total[key]
            return bulk and may_wrap(key[-1]) or biggest[key] > 0 and (
                biggest[key] > outside[key] and 2 * biggest[key] >= own[key] or bulk and not outside[key])

        more = {key for key in own if encloses_main(key)}
        if not more:
            return frozenset(wrappers)
        wrappers |= {max(more, key=lambda k: (biggest[k], own[k], [(a, b, sorted(c)) for a, b, c in k]))}


def judge_articles(pages: list[list[Token]], outlines: list[Outline], weights: list[list[int]]) -> dict[frozenset, str]:
    """What the articles are on the pages of each build: the only main text
    ("only": one a page, and half of the varying text or more), part of it
    ("some"), or lists of links beside it ("links")."""
    inside, total, most = Counter(), Counter(), Counter()
    linked, length = Counter(), Counter()
    for page, o, weight in zip(pages, outlines, weights):
        if not o.n_articles:
            continue
        most[o.build] = max(most[o.build], o.n_articles)
        link = 0
        for t, w, hidden, article in zip(page, weight, o.hidden, o.article):
            if hidden:
                continue
            if t.name == "a" and t.kind != "text":
                link = t.kind == "open"
            total[o.build] += w
            if article:
                inside[o.build] += w
                if t.kind == "text":
                    length[o.build] += len(t.role) - 1
                    linked[o.build] += link * (len(t.role) - 1)
    return {b: "only" if 2 * inside[b] >= total[b] and (n == 1 or inside[b] == total[b])
            else "links" if n > 1 and 2 * linked[b] > length[b] else "some" for b, n in most.items()}


def in_order(places: list[list[int]]) -> list[int]:
    """Positions of a longest run of columns whose places increase on the first
    page and, taken greedily, on all others."""
    order = sorted(range(len(places[0])), key=lambda j: places[0][j])
    kept: list[int] = []
    for j in order:
        while kept and any(p[kept[-1]] >= p[j] for p in places):
            # the two disagree somewhere: keep the one that agrees with more others
            if sum(all((p[j] > p[k]) == (places[0][j] > places[0][k]) for p in places) for k in order) <= \
                    sum(all((p[kept[-1]] > p[k]) == (places[0][kept[-1]] > places[0][k]) for p in places) for k in order):
                break
            kept.pop()
        if not kept or all(p[kept[-1]] < p[j] for p in places):
            kept.append(j)
    return kept


def deduce(pages: list[list[Token]]) -> Template:
    """Template of a group of pages."""
    counts = [Counter(t.role for t in page) for page in pages]
    vectors: dict[tuple, list[str]] = defaultdict(list)
    for role in counts[0]:
        if all(role in c for c in counts[1:]):
            vectors[tuple(c[role] for c in counts)].append(role)
    once = tuple([1] * len(pages))
    roles = vectors.pop(once, [])
    if len(pages) == 1:      # one page says nothing about its texts: only tags can be the template's
        roles = [r for r in roles if not r.startswith("T")]
    where = [{t.role: i for i, t in enumerate(page)} for page in pages]
    skeleton = [roles[j] for j in in_order([[w[r] for r in roles] for w in where])] if roles else []
    template = Template(skeleton)

    # slots of every token, then classes that repeat: valid if they stay in one slot
    slot_of: list[list[int]] = []
    marks = {r: i for i, r in enumerate(skeleton)}
    for page in pages:
        at, slots = 0, []
        for t in page:
            if t.role in marks:
                at = marks[t.role] + 1
            slots.append(at)
        slot_of.append(slots)
    for vector, members in vectors.items():
        if len(members) > 1:
            inside = {s for page, slots in zip(pages, slot_of) for t, s in zip(page, slots) if t.role in members}
            if len(inside) == 1:
                template.nested.setdefault(inside.pop(), []).append(frozenset(members))

    # what each slot holds and, on the first page, what encloses it
    ends, weights = [element_ends(page) for page in pages], varying_text(pages, counts)
    template.wrappers = find_wrappers(pages, ends, weights)
    outlines = [outline(page, end, template.wrappers) for page, end in zip(pages, ends)]
    template.articles = judge_articles(pages, outlines, weights)
    first = outlines[0]
    around = [(False, False), *((bool(h), bool(a)) for t, h, a in zip(pages[0], first.hidden, first.article) if t.role in marks)]
    allowed = [not h for h, _ in around]
    texts = [[set() for _ in pages] for _ in around]
    linked, length = [0] * len(around), [0] * len(around)
    for p, (page, slots) in enumerate(zip(pages, slot_of)):
        link = 0
        for t, s, hidden in zip(page, slots, outlines[p].hidden):
            if t.name == "a" and t.kind != "text":
                link = 1 if t.kind == "open" else 0
            if t.kind == "text" and t.role != "T" and t.role not in marks and not hidden:
                texts[s][p].add(t.role)
                length[s] += len(t.role)
                linked[s] += link * len(t.role)
    # what never varies before the first or after the last varying slot is the template's
    varying = [i for i, slot in enumerate(texts) if len({frozenset(x) for x in slot}) > 1]
    lo, hi = (varying[0], varying[-1]) if varying else (0, len(texts))
    template.main = [(any(texts[i]) or a) and (m or lo <= i <= hi and 2 * k <= n)
                     for i, (a, (_, m), k, n) in enumerate(zip(allowed, around, linked, length))]
    return template


def extract(page: list[Token], template: Template) -> str:
    """Blocks of the slots that remain, joined by line ends."""
    marks = {r: i for i, r in enumerate(template.skeleton)}
    o = outline(page, element_ends(page), template.wrappers)
    articles = template.articles[o.build] if o.n_articles else ""
    slot, lacks = 0, not any(template.main)
    blocks: list[str] = []
    words: list[str] = []

    def close_block() -> None:
        block = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if block:
            blocks.append(block)

    for t, hidden, article in zip(page, o.hidden, o.article):
        if t.role in marks:
            slot = marks[t.role] + 1
        if hidden:
            close_block()
        elif t.kind == "text":
            if article and articles != "links" or articles != "only" and not article and (lacks or template.main[slot]):
                words.append(t.name)
        elif t.name == "br":
            words.append(" ")
        elif t.name not in INLINE:
            close_block()
    close_block()
    return "\n".join(blocks)


def extract_group(pages: list[str]) -> list[str]:
    """Main texts of a group of same-host pages."""
    parsed = [tokens(p) for p in pages]
    some = [p for p in parsed if p]
    if not some:
        return [""] * len(pages)
    template = deduce(some)
    return [extract(p, template) if p else "" for p in parsed]


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
              group_pages: int = GROUP_PAGES) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars, host.

    Character references are decoded, white space inside a block becomes one
    blank, blocks are joined by a line end in page order.  Null or empty pages
    give an empty text; a null url belongs to the host "".  Ids may be null or
    repeat: rows are independent but for the template of their group.  Other
    columns are not read.  Hosts are dealt by a hash of the row to groups of
    about ``group_pages`` pages, so no task holds a whole large host.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).withColumn(
        "host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))))
    # only hosts of more than one group need their size; few enough are broadcast, so
    # that pages move once, by (host, group), and never by host alone
    large = rows.groupBy("host").agg(F.ceil(F.count("*") / group_pages).alias("groups")).where("groups > 1") \
        .withColumnRenamed("host", "_host")
    few = large.count() <= BROADCAST_HOSTS
    dealt = rows.join(F.broadcast(large) if few else large, F.col("host") == F.col("_host"), "left").withColumn(
        "group", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("groups", F.lit(1)))).drop("_host", "groups")
    if not few:
        dealt = dealt.repartition("host", "group")
    id_type = pages.schema[page_id].dataType.simpleString()

    def run(part: pa.Table) -> pa.Table:
        texts = extract_group([h or "" for h in part.column("html").to_pylist()])
        return pa.table([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                         pa.array([len(t) for t in texts], pa.int64()), part.column("host")],
                        names=["page_id", "url", "text", "n_chars", "host"])

    return dealt.groupBy("host", "group").applyInArrow(
        run, f"page_id {id_type}, url string, text string, n_chars long, host string")
