"""HTML extraction by equivalence-class template deduction.

Pages are cut into tokens: tags named by their path of open elements (with
class and id), and text blocks named by path and content.  For each host

1. every token's occurrence vector over the host's pages is summed into a
   128-bit signature (an order-free sum of hashes of page, token count), so
   the vectors themselves are never gathered; tokens with equal signatures form
   an equivalence class;
2. a class is valid if its tokens occur in most of the pages, equally often and
   in the same order, each time nested in the class before it; valid classes
   that occur once a page nest into the host's template;
3. the places between template tokens are slots: what a page has there is its
   own.  The main element is the template element that holds most of the host's
   slot text, so a long text that all pages repeat does not count; of several
   nested ones a marked article is taken, else the deepest.  Boilerplate elements
   (menus, adverts and the like, by tag, role or class name) hold no slots.  A
   class name or a form is a weak sign: it does not count for an element that
   holds the page's article or the bulk of the host's text, and inside the main
   element a name counts only if it is one as a whole (``comments``,
   ``related-posts``, not ``related-work``), an unsure one (``related``,
   ``search``) only for a list of links.

The page pass then locates the main element in each page, climbs from an
unmarked one to the smallest element that holds all of the page's slot text, and
writes out its remaining slots.  Hosts with too few pages, and pages that do not fit their
host's template, use the template deduced over all hosts together, and at last
the page's own largest element.

Signatures are partial aggregates, so a hot host is one row a task and token.
A template has at most a page's number of tokens.  Templates are broadcast only
while their measured size is small; beyond that pages are joined by host.

Defined cases: null or empty html has an empty text; a null url belongs to the
host ``""``; unclosed and stray tags are tolerated; repeated rows are pages of
their own; character references are decoded, white space in a block becomes one
space, blocks are joined by one space; nothing else is dropped or capped.  Broken
markup is read in linear time: a tag that is never closed reaches to the end.
An empty table gives an empty result; only ``page_id``, ``url`` and ``html`` are
read, whatever further columns there are.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodia.llm.shared import stored
from episodia.llm.textkernel import slices

MIN_PAGES = 4  # of a host that gets a template of its own
SUPPORT = 0.6  # share of a host's pages that a valid class occurs in
MASS = 0.6  # share of the slot text that the main element holds
BULK = 0.5  # share of a host's text in an element that makes it a wrapper, whatever its name
BROADCAST_BYTES = 16 << 20
LONG_PATH = 1000

#: A value is quoted only after ``=``.  Nothing is tried twice (possessive repeats), and what is never closed reaches to the end.
ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
SCANNER = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|textarea|select|svg|iframe|object|canvas|annotation-xml|annotation)\b{ATTRIBUTES}(?:>.*?(?:</\1\s*+>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mover mrow mroot ms msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
#: Elements that end when one of these opens inside them.
ENDS = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SCOPES = frozenset("article aside body div footer header html main nav section table ul ol td th".split())
BOILER_TAGS = frozenset("head nav header footer aside form button menu dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that add nothing to such a name: with them alone beside it, a name is still a whole one.
FURTHER_NAMES = frozenset("area bar block box buttons button form group item items link links list post posts section slot top bottom left right unit".split())
#: Names that an article's own section may have; inside the main element they count only for lists of links.
UNSURE_NAMES = frozenset("promotion recommended related responses search social subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORD_IN_NAME = re.compile(r"[a-z]+|\d+")


@lru_cache(maxsize=1 << 16)
def _element(name: str, attributes: str) -> tuple[str, bool, int, bool]:
    """Label of an element (name, class, id), whether it is boilerplate, whether part of a name (-1), a form (1), a whole name (2) or an unsure one (3) says so, whether it is marked as the article."""
    if not attributes.strip():
        return name, name in BOILER_TAGS and name != "form", int(name == "form"), name in ("article", "main")
    got: dict[str, str] = {}
    for k, a, b, c in ATTRIBUTE.findall(attributes):
        got.setdefault(k.lower(), a or b or c)  # of an attribute given twice the first counts
    role = got.get("role", "").lower()
    tokens = [[*WORD_IN_NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", x).lower())] for x in (got.get("class", "") + " " + got.get("id", "")).split()]
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", got.get("style", "")))
    main = name in ("article", "main") or role in ("main", "article") or got.get("itemprop") == "articleBody"
    boiler = (name in BOILER_TAGS and name != "form") or (role in BOILER_ROLES and role != "form") or hidden
    named = any(x in BOILER_NAMES for words in tokens for x in words)
    whole = any(words[0] in BOILER_NAMES and all(x in BOILER_NAMES or x in FURTHER_NAMES or x.isdigit() for x in words) for words in tokens if words)
    sure = any(words[0] in BOILER_NAMES and not (len(words) == 1 and words[0] in UNSURE_NAMES) and all(x in BOILER_NAMES or x in FURTHER_NAMES or x.isdigit() for x in words) for words in tokens if words)
    form = name == "form" or role == "form"
    weak = 0 if name in ("html", "body") else 2 if sure else 1 if form else 3 if whole else -1 if named else 0
    label = name + "".join(f".{x}" for x in sorted(got.get("class", "").split())) + (f"#{got['id']}" if got.get("id") else "")
    return label, boiler, weak, main


class Page:
    """Elements and text blocks of a page, in page order.

    ``wrappers`` are paths of elements whose name or form does not make them boilerplate.
    """

    def __init__(self, html: str, wrappers: frozenset | set = frozenset()):
        self.path: list[str] = [""]  # of each element
        self.parent: list[int] = [-1]
        self.boiler: list[bool] = [False]
        self.own: list[bool] = [False]  # boilerplate by tag, role or hidden
        self.weak: list[int] = [0]  # boilerplate by name or form
        self.main: list[bool] = [False]
        self.tag: list[str] = [""]
        self.blocks: list[tuple[int, str]] = []  # element, text
        self.linked: list[int] = []  # of each block, characters of the source inside links
        stack, parts, at, links, in_link = [0], [], 0, 0, False
        open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
        scopes: list[int] = []  # places in the stack of elements that a stray close does not leave

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self.blocks.append((stack[-1], text))
                    self.linked.append(min(links, len(text)))
            links = 0

        def close_to(place: int) -> None:
            for e in reversed(stack[place:]):
                open_at[self.tag[e]].pop()
            del stack[place:]
            while scopes and scopes[-1] >= place:
                scopes.pop()

        for m in SCANNER.finditer(html):
            if m.start() > at:
                parts.append(html[at : m.start()])
                links += (m.start() - at) * in_link
            at = m.end()
            name = m[3]
            if not name:
                if m[1]:
                    flush()
                continue
            name = name.lower()
            if name == "a":
                in_link = not m[2]
            if name in INLINE:
                if not m[2] and m[4]:
                    _, boiler, weak, _ = _element(name, m[4])
                    if not boiler and not weak:
                        continue
                elif not m[2] or name not in [self.tag[i] for i in stack[-1:]]:
                    continue
            flush()
            if m[2]:
                if (there := open_at.get(name)) and (name in SCOPES or not scopes or there[-1] > scopes[-1]):
                    close_to(there[-1])
                continue
            if name in VOID:
                continue
            while len(stack) > 1 and name in ENDS.get(self.tag[stack[-1]], ()):
                close_to(len(stack) - 1)
            label, boiler, weak, main = _element(name, m[4])
            up = stack[-1]
            above = self.path[up]
            # the path of a very deep element begins with a digest, so paths stay short
            self.path.append(f"{above}/{label}" if len(above) < LONG_PATH else f"~{_hash(above):x}/{label}")
            self.parent.append(up)
            self.own.append(boiler)
            self.weak.append(weak)
            self.main.append(main)
            self.tag.append(name)
            open_at.setdefault(name, []).append(len(stack))
            if name in SCOPES:
                scopes.append(len(stack))
            stack.append(len(self.path) - 1)
        if at < len(html):
            parts.append(html[at:])
        flush()

        self.weak_text = [0] * len(self.path)  # characters in each element, weak boilerplate included
        self.in_main = [-1] * len(self.path)  # the innermost marked element around each, itself included
        self.article = -1
        self._judge(wrappers)

    def _judge(self, wrappers: frozenset | set) -> None:
        """Settle what is boilerplate: inherited, but a name or form does not count around the article or in ``wrappers``.

        A header inside a marked element is the article's own.
        """
        n = len(self.path)
        outer, named, in_main = [False] * n, [False] * n, self.in_main
        for e in range(1, n):
            up = self.parent[e]
            in_main[e] = e if self.main[e] else in_main[up]
            own = self.own[e] and not (self.tag[e] == "header" and in_main[up] >= 0)
            outer[e] = own or outer[up]
            named[e] = named[up] or (bool(self.weak[e]) and not self.main[e] and self.path[e] not in wrappers)
        self.weak_text = size = self._sums([not x for x in outer])
        marked = [e for e in range(1, n) if self.main[e] and size[e] and not outer[e]]
        plain = [e for e in marked if not self.weak[e]] or marked
        among = set(plain)
        tops = [e for e in plain if in_main[self.parent[e]] not in among]
        fit = [e for e in tops if not named[e] or self.tag[e] == "main"]
        if len(fit) < len(tops):
            outweighs = self._outweighing(size, wrappers)
            fit = [e for e in tops if not named[e] or self.tag[e] == "main" or outweighs[e]]
        if fit:
            self.article = max(fit, key=lambda e: (size[e], -e))
        clear, e = set(), self.article
        while e > 0:
            clear.add(e)
            e = self.parent[e]
        all_text, link_text = self._sums([True] * n), [0] * n
        for (e, _), linked in zip(self.blocks, self.linked):
            link_text[e] += linked
        for e in range(n - 1, 0, -1):
            link_text[self.parent[e]] += link_text[e]
        self.boiler, in_article = [False] * n, [False] * n
        for e in range(1, n):
            up, kind = self.parent[e], self.weak[e]
            inside_main = in_main[up] >= 0 and (self.article < 0 or in_main[up] == self.article or in_article[up])
            in_article[e] = in_article[up] or e == self.article
            counts = kind > 0 and (kind < 3 or 2 * link_text[e] >= all_text[e]) if inside_main else kind != 0
            weak = counts and not self.main[e] and e not in clear and self.path[e] not in wrappers
            own = self.own[e] and not (self.tag[e] == "header" and in_main[up] >= 0)
            self.boiler[e] = own or weak or self.boiler[up]

    def _outweighing(self, size: list[int], wrappers: frozenset | set) -> list[bool]:
        """Teasers and comments may be articles in a named box: whether no element beside each one's box, whole names aside, holds more text."""
        n = len(self.path)
        rivals: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # the two largest children of each element, whole names aside
        for x in range(1, n):
            if self.weak[x] < 2:
                rivals[self.parent[x]] = sorted([*rivals[self.parent[x]], (size[x], x)])[-2:]
        named, beside = [-1] * n, [0] * n  # the outermost named element around each, and the largest rival on the way down
        for x in range(1, n):
            up = self.parent[x]
            beside[x] = max([beside[up], *(k for k, y in rivals[up] if y != x)])
            named[x] = named[up] if named[up] >= 0 else x if self.weak[x] and self.path[x] not in wrappers else -1
        boxes = [named[up] if up >= 0 and named[up] >= 0 else x for x, up in enumerate(self.parent)]
        return [size[b] >= beside[b] for b in boxes]

    def _sums(self, counts: list[bool], constant: frozenset | set = frozenset()) -> list[int]:
        out = [0] * len(self.path)
        for e, text in self.blocks:
            if counts[e] and (not constant or _hash(f"{self.path[e]}\t{text}") not in constant):
                out[e] += len(text)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def mass(self, constant: frozenset | set = frozenset()) -> list[int]:
        """Characters of slot text in each element, its inner elements included."""
        return self._sums([not x for x in self.boiler], constant)

    def text(self, root: int, constant: frozenset | set = frozenset(), core: int = 0) -> str:
        """The slots below ``root``; ``constant`` blocks belong to the template, except inside ``core`` (if not 0)."""
        inside, kept = [False] * len(self.path), [False] * len(self.path)
        inside[root] = True
        for e in range(1, len(inside)):
            inside[e] = inside[e] or inside[self.parent[e]]
            kept[e] = e == core or kept[self.parent[e]]
        return " ".join(t for e, t in self.blocks if inside[e] and not self.boiler[e] and (kept[e] or not constant or _hash(f"{self.path[e]}\t{t}") not in constant))

    def largest(self, share: float = MASS) -> int:
        """The page's marked article, or the deepest element that holds most of its text."""
        if self.article >= 0:
            return self._all_marked()
        mass = self.mass()
        total, best = mass[0], 0
        for e in range(1, len(mass)):
            if self.tag[e] not in ENDS and self.tag[e] not in HEADINGS and self.parent[e] == best and total and mass[e] >= share * total:
                best = e
        return best

    def _all_marked(self, share: float = MASS) -> int:
        """The outermost marked article; what holds all of them where the largest has not most of their text."""
        mass = self.mass()
        tops = [e for e in range(1, len(mass)) if self.main[e] and mass[e] and not self.boiler[e] and self.in_main[self.parent[e]] < 0]
        if self.article in tops and mass[self.article] >= share * sum(mass[e] for e in tops):
            return self.article
        return self._around(tops) if tops else self.article

    def _around(self, elements: list[int]) -> int:
        """The smallest element around all of ``elements``."""
        held = [0] * len(self.path)
        for e in elements:
            held[e] += 1
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        at = elements[0]
        while held[at] < len(elements):
            at = self.parent[at]
        return at

    def climb(self, core: int, constant: frozenset | set = frozenset()) -> int:
        """The smallest element that holds ``core`` and all slot text."""
        slots = {e for e, t in self.blocks if not self.boiler[e] and not (constant and _hash(f"{self.path[e]}\t{t}") in constant)}
        return self._around([core, *slots])


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def host_of(url: Column) -> Column:
    """Lower-case host between ``://`` and the next ``/``, ``?`` or ``#``; empty where there is none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.lower(F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*", 0))), F.lit(""))


def wrappers(pages: DataFrame, bulk: float = BULK) -> DataFrame:
    """``host, wrappers``: paths that look like boilerplate by name or form and hold the bulk of the host's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            sums: dict[tuple, int] = {}
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                p = Page(source or "")
                sums[host, ""] = sums.get((host, ""), 0) + p.weak_text[0]
                inside = [p.article < 0] * len(p.path)  # beside a marked article there is nothing to free
                for e in range(1, len(p.path)):
                    inside[e] = inside[p.parent[e]] or e == p.article
                    if p.weak[e] and not p.main[e] and inside[e]:
                        sums[host, p.path[e]] = sums.get((host, p.path[e]), 0) + p.weak_text[e]
            if sums:
                host, path = zip(*sums)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(list(sums.values()), pa.int64())], ["host", "path", "size"])

    sums = stored(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, size long").groupBy("host", "path").agg(F.sum("size").alias("size")))
    whole = sums.where("path = ''").select("host", F.col("size").alias("whole"))
    return stored(sums.where("path <> ''").join(whole, "host").where((F.col("size") > F.col("whole") * bulk)).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("wrappers")))


def with_wrappers(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with ``host``, a number of their own (``page``) and their host's ``wrappers`` (null for most).

    Pages are numbered before any shuffle, so a task that is run again gives them the same numbers.
    """
    number = F.xxhash64("page_id", "url", F.octet_length("html"), F.monotonically_increasing_id())
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), number.alias("page"))
    weight = found.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("wrappers", " ")) + 64)).first()[0] or 0
    return keyed.join(F.broadcast(found) if weight <= BROADCAST_BYTES else found, "host", "left")


TOKENS = "host string, token long, path string, is_text boolean, is_main boolean, boiler boolean, times int, place int, mass long, page long"


def page_tokens(pages: DataFrame) -> DataFrame:
    """Distinct tokens of each page (with ``host`` and ``wrappers``): how often, where first, and the slot text below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            out: list[tuple] = []
            for host, source, page, wrap in zip(*(b.column(c).to_pylist() for c in ("host", "html", "page", "wrappers"))):
                p = Page(source or "", frozenset(wrap or ()))
                mass = p.mass()
                own: dict[int, list] = {}
                for e in range(1, len(p.path)):
                    t = own.setdefault(_hash(p.path[e]), [p.path[e], False, p.main[e], p.boiler[e], 0, e, 0])
                    t[4] += 1
                    t[6] += mass[e]
                for e, text in p.blocks:
                    t = own.setdefault(_hash(f"{p.path[e]}\t{text}"), ["", True, False, p.boiler[e], 0, e, 0])
                    t[4] += 1
                    t[6] += len(text)
                out += [(host, k, *v, page) for k, v in own.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["host", "token", "path", "is_text", "is_main", "boiler", "times", "place", "mass", "page"])

    return pages.select("host", "html", "wrappers", "page").mapInArrow(run, TOKENS)


def equivalence_classes(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """Classes of the frequent tokens of pages with ``host`` and ``wrappers``: equal occurrence vectors, hence equal signatures (``v1, v2``).

    The host null stands for all hosts together, with elements only.
    """
    tokens = page_tokens(pages)
    vector = lambda k: F.sum(F.xxhash64(F.lit(k), "page", "times").cast("decimal(20,0)"))  # noqa: E731  a sum that cannot overflow
    per_host = stored(
        tokens.groupBy("host", "token").agg(
            F.max("path").alias("path"), F.first("is_text").alias("is_text"), F.max("is_main").alias("is_main"), F.max("boiler").alias("boiler"),
            F.count("*").alias("pages"), F.max("times").alias("times"), F.min("place").alias("first"), F.max("place").alias("last"), F.sum("mass").alias("mass"),
            vector(1).alias("v1"), vector(2).alias("v2"),
        )
    )
    everywhere = per_host.where(~F.col("is_text")).groupBy("token").agg(
        F.max("path").alias("path"), F.first("is_text").alias("is_text"), F.max("is_main").alias("is_main"), F.max("boiler").alias("boiler"),
        F.sum("pages").alias("pages"), F.max("times").alias("times"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("mass").alias("mass"),
        F.sum("v1").alias("v1"), F.sum("v2").alias("v2"),
    ).select(F.lit(None).cast("string").alias("host"), "*")
    every = per_host.unionByName(everywhere)
    size = every.where(~F.col("is_text")).groupBy("host").agg(F.max("pages").alias("host_pages"))
    join = every["host"].eqNullSafe(size["host"])
    frequent = every.join(size, join).drop(size["host"]).where((F.col("host_pages") >= min_pages) & (F.col("pages") >= F.col("host_pages") * support))
    return frequent.groupBy("host", "v1", "v2", "pages", "times", "host_pages").agg(F.collect_list(F.struct("first", "last", "path", "token", "is_text", "is_main", "boiler", "mass")).alias("members"))


def nested_templates(classes: DataFrame) -> DataFrame:
    """``host, members``: the tokens of valid classes, which occur once a page and in one order everywhere, in that order."""
    valid = classes.where(F.col("times") == 1).groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("members"))
    by_last = F.array_sort(F.transform("members", lambda m: F.struct(m["last"].alias("last"), m["first"].alias("first"), m["path"].alias("path"), m["token"].alias("token"))))
    return valid.withColumn("_last", by_last).select("host", F.filter("members", lambda m, i: F.get("_last", i)["token"] == m["token"]).alias("members"))


def _broadcast_if_small(known: DataFrame, weight: Column) -> DataFrame:
    return F.broadcast(known) if (known.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_BYTES else known


def slot_masses(pages: DataFrame, nested: DataFrame) -> DataFrame:
    """``host, token, slots``: the text below each template element of a host that is no part of the template, over all its pages."""
    elements = F.transform(F.filter("members", lambda m: ~m["is_text"]), lambda m: m["token"]).alias("elements")
    constants = F.transform(F.filter("members", lambda m: m["is_text"]), lambda m: m["token"]).alias("constants")
    rows = nested.select("host", elements, constants)
    common = rows.where("host is null").limit(1).collect()  # one row of at most a page's elements
    shared = frozenset(common[0]["elements"]) if common else frozenset()
    known = rows.where("host is not null").withColumnRenamed("host", "_host")
    known = _broadcast_if_small(known, F.octet_length("_host") + 8 * (F.size("elements") + F.size("constants")) + 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            sums: dict[tuple, int] = {}
            for host, source, wrap, own, fixed in zip(*(b.column(c).to_pylist() for c in ("host", "html", "wrappers", "elements", "constants"))):
                p = Page(source or "", frozenset(wrap or ()))
                own = frozenset(own or ())
                for e, n in enumerate(p.mass(frozenset(fixed or ()))):
                    if n:
                        token = _hash(p.path[e])
                        for of, wanted in ((host, own), (None, shared)):
                            if token in wanted:
                                sums[of, token] = sums.get((of, token), 0) + n
            if sums:
                host, token = zip(*sums)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(token, pa.int64()), pa.array(list(sums.values()), pa.int64())], ["host", "token", "slots"])

    joined = pages.select("host", "html", "wrappers").join(known, F.col("host") == F.col("_host"), "left")
    return joined.select("host", "html", "wrappers", "elements", "constants").mapInArrow(run, "host string, token long, slots long").groupBy("host", "token").agg(F.sum("slots").alias("slots"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT, mass: float = MASS) -> DataFrame:
    """``host, main_path, constants`` of pages with ``host`` and ``wrappers``: the path of the main element and the constant text blocks around it.

    The main element holds most of the host's slot text.  Where several nested
    ones do, the outermost one that is marked as the article is taken, else the
    deepest.  A host without slots (its pages are copies) goes by all text.  The
    host null stands for all hosts together.
    """
    nested = stored(nested_templates(equivalence_classes(pages, min_pages, support)))
    elements = nested.select("host", F.inline(F.filter("members", lambda m: ~m["is_text"] & ~m["boiler"])))
    slots = slot_masses(pages, nested)
    weighed = elements.join(slots, elements["host"].eqNullSafe(slots["host"]) & (elements["token"] == slots["token"]), "left").select(elements["*"], F.coalesce("slots", F.lit(0)).alias("slots"))
    per = weighed.groupBy("host").agg(F.max("slots").alias("most"), F.max("mass").alias("all"), F.collect_list(F.struct("path", "is_main", "slots", "mass")).alias("elements"))
    weight = lambda m: F.when(F.col("most") > 0, m["slots"]).otherwise(m["mass"])
    total = F.when(F.col("most") > 0, F.col("most")).otherwise(F.col("all"))
    held = F.filter("elements", lambda m: weight(m) >= total * mass)
    marked = F.filter(held, lambda m: m["is_main"])
    by_depth = lambda a: F.array_sort(F.transform(a, lambda m: F.struct(F.size(F.split(m["path"], "/")).alias("n"), m["path"].alias("path"))))
    body = F.filter(held, lambda m: ~F.regexp_like(m["path"], F.lit(r"/(p|li|h[1-6]|td|tr|dd|dt)([.#][^/]*)?$")))
    main = F.when(F.size(marked) > 0, F.element_at(by_depth(marked), 1)["path"]).when(F.size(body) > 0, F.element_at(by_depth(body), -1)["path"])
    chosen = per.select(F.col("host").alias("_host"), main.alias("main_path"), "most").where("main_path is not null")
    # where all pages are copies, what they repeat is their text too
    constants = F.transform(F.filter("members", lambda m: m["is_text"] & (F.col("most") > 0)), lambda m: m["token"])
    return nested.join(chosen, F.col("host").eqNullSafe(F.col("_host"))).select("host", "main_path", constants.alias("constants"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT, mass: float = MASS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    wrapped = with_wrappers(pages, wrappers(pages))
    known = stored(templates(wrapped, min_pages, support, mass))
    common = known.where("host is null").limit(1).collect()
    shared_path = common[0]["main_path"] if common else None
    own = known.where("host is not null").withColumnRenamed("host", "_host")
    own = _broadcast_if_small(own, F.octet_length("main_path") + F.octet_length("_host") + 8 * F.size("constants") + 64)
    keyed = wrapped.select("page_id", "url", "html", "wrappers", F.col("host").alias("_host"))
    joined = keyed.join(own, "_host", "left")
    shape = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            texts = []
            for source, path, constants, wrap in zip(*(b.column(c).to_pylist() for c in ("html", "main_path", "constants", "wrappers"))):
                p = Page(source or "", frozenset(wrap or ()))
                core = -1
                for wanted in (path, shared_path):
                    fit = [e for e in range(len(p.path)) if p.path[e] == wanted] if wanted else []
                    if len(fit) == 1 and (wanted == path or p.main[fit[0]] or p.article < 0):
                        core = fit[0]
                        break
                own = core < 0 and p.article >= 0  # the page's own marked article
                if core < 0:
                    core = p.largest()
                constant = frozenset(constants or ())
                root = core if own or p.main[core] else p.climb(core, constant)
                # inside the article's own container every block is content; around it constant blocks are the template's
                if not p.main[core] and constant:
                    bare = p.tag[core] in ("", "html", "body")
                    texts.append(p.text(root, constant, 0 if bare else core) or p.text(root))
                else:
                    texts.append(p.text(root))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "main_path", "constants", "wrappers").mapInArrow(run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
