"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree of element paths, all of their blocks included. A path's
presentation importance grows with the entropy of its layouts (the sequences of what its elements
hold, repetitions taken together): what every page has in the same shape is a template. Its content importance is one minus
the mean entropy of its texts over the pages that have the path: a text on every page says nothing.
Sparse hosts are shrunk toward the same path over all hosts, and those toward a neutral value. A
block counts for as much as the most important branch that holds it, by presentation or by its
share of the page's text, times its content importance. What HTML itself calls navigation, forms and
so on, and words of class and id, are priors that multiply this. Blocks of low importance go.

Repetition alone doesn't take an article away: where it would take most of a page's main branch
(its articles, or else the deepest element that holds most of its text), the pages are editions of one article, and
repetition is judged outside that branch only.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches, tidy

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the first kind ends where one of the second begins.
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
#: Factors of elements by tag or role, of class words, of those that mean readers' comments, and of articles.
TAGS = {**dict.fromkeys("nav header footer aside form button dialog menu head fieldset".split(), 0.1)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MARKED, COMMENTED, ARTICLE = 0.2, 0.05, 2.0
#: Words of class and id attributes by which sites mark what is no article, and layouts that have it.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside rail widget related recommended share sharing social cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist disqus respond replies discussion pagination pager toolbar skip copyright legal disclaimer search".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies discussion".split())
#: First parts of a hyphenated name that say what a layout has or lacks, and elements whose own names are no evidence.
ABOUT = frozenset("no not has have with without is hide show page site layout wrap wrapper container content main post entry".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption html body article main".split())
MAIN = frozenset(["article", "main"])
#: Share of the page's text beyond which a tag or class word says nothing on a page without articles, for comments the second; importance of what is unknown.
MOST, NEARLY_ALL, NEUTRAL = 0.5, 0.9, 0.5
#: Blocks that a main branch has at least where no tag names it: a box with a line or two is no article.
FEW = 3


class Element:
    """One element of a page: its tag, its path (a chained name, as deep pages have long ones), the element around it, its
    prior and whether that is of comments, the layout of what it holds, and the characters of its subtree, in all and of articles."""

    __slots__ = ("name", "path", "above", "prior", "comments", "main", "layout", "chars", "main_chars")

    def __init__(self, name: str, step: str, above: Element | None, prior: float, comments: bool, main: bool):
        self.name, self.above, self.prior, self.comments, self.main, self.layout, self.chars, self.main_chars = name, above, prior, comments, main, [], 0, 0
        self.path = f"{mark('step', above.path if above else '', step):x}"

    def hold(self, what: str) -> None:
        if self.layout[-1:] != [what]:
            self.layout.append(what)


class Block:
    """Text of one block and its element."""

    __slots__ = ("element", "text")

    def __init__(self, element: Element, text: str):
        self.element, self.text = element, text


def _words(value: str) -> tuple[list[str], list[str]]:
    """All words of a class or id value, and those that may mark an element: the first or last part of a name."""
    every, marking = [], []
    for name in value.lower().split():
        parts = _WORD.findall(name)
        every += parts
        if parts and parts[0] not in ABOUT:
            marking += [parts[0], parts[-1]]
    return every, marking


def _element(name: str, attributes: str, above: Element | None) -> Element:
    step, prior, comments = name, 1.0, False
    inside = above is not None and above.main
    prior *= 1.0 if inside and name == "header" else TAGS.get(name, 1.0)
    role = ""
    if attributes and not attributes.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        named = [_words(found.get(a, "")) for a in ("class", "id")]
        role = found.get("role", "").lower()
        marking = {w for _, m in named for w in m}
        if name not in LEAVES and not COMMENTS.isdisjoint(marking):
            prior, comments = prior * COMMENTED, True
        elif name not in LEAVES and not MARKS.isdisjoint(marking):
            prior *= MARKED
        if role in ROLES:
            prior = min(prior, TAGS["nav"])
        if "hidden" in found or found.get("aria-hidden") == "true":
            prior = 0.0
        names = sorted({w for every, _ in named for w in every})
        if names:
            step += "." + ".".join(names)
    main = name in MAIN or role == "main"
    if main and not inside:
        prior *= ARTICLE
    return Element(name, step, above, prior, comments, main or inside)


def blocks(page: str | None) -> list[Block]:
    """Blocks of the whole page in order. White space in a block is one blank; empty blocks are left out."""
    if not page:
        return []
    out: list[Block] = []
    root = Element("", "", None, 1.0, False, False)
    every = [root]
    stack: list[tuple[str, Element]] = [("", root)]  # inline elements stand for the element around them
    buffer: list[str] = []
    style: list[str] = []

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html_entities.unescape("".join(buffer))).strip()
            if text:
                element = stack[-1][1]
                element.hold("+".join(["text", *style]))
                out.append(Block(element, text))
                element.chars += len(text)
                element.main_chars += len(text) if element.main else 0
            buffer.clear()
        style.clear()

    at, size = 0, len(page)
    while at < size:
        cut = page.find("<", at)
        m = _TOKEN.match(page, cut) if cut >= 0 else None
        if m is None:
            stop = size if cut < 0 else cut + 1
            buffer.append(page[at:stop])
            at = stop
            continue
        if cut > at:
            buffer.append(page[at:cut])
        at = m.end()
        closing, name = (m[1], m[2]) if m[2] else (m[4], m[5])
        if not name:
            if m[0].startswith("<![CDATA["):
                buffer.append(html_entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if closing:
            if name == "br":
                buffer.append(" ")
                continue
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if name in INLINE and any(x[0] not in INLINE for x in stack[k:]):
                        break
                    del stack[k:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if not (m[3] or "").rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if name in INLINE:
            style.append(name)
            if name in ("br", "wbr"):
                buffer.append(" " if name == "br" else "")
            else:
                stack.append((name, stack[-1][1]))
            continue
        flush()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == "p" or name in CLOSED_BY.get(stack[k][0], ()):
                del stack[k:]
                break
            if stack[k][0] not in INLINE:
                break
        if name in VOID:
            continue
        above = stack[-1][1]
        above.hold(name)
        stack.append((name, _element(name, m[3] or "", above)))
        every.append(stack[-1][1])
    flush()
    for element in reversed(every[1:]):  # those inside come after those around
        element.above.chars += element.chars
        element.above.main_chars += element.main_chars
    return out


def mark(kind: str, *parts: str) -> int:
    """64-bit name of a path, layout or text."""
    return int.from_bytes(hashlib.blake2b("\0".join([kind, *parts]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def features(found: list[Block]) -> list[tuple[str, bool, int]]:
    """(path, is text, name): the layout of every path of a page, over all its elements, and its distinct texts."""
    layouts: dict[str, list[str]] = {}
    seen: set[int] = set()
    for b in found:
        element = b.element
        while element is not None and id(element) not in seen:
            seen.add(id(element))
            own, layout = layouts.setdefault(element.path, []), " ".join(element.layout)
            if own[-1:] != [layout]:
                own.append(layout)
            element = element.above
    texts = sorted({(b.element.path, b.text) for b in found})
    return [(p, False, mark("layout", *x)) for p, x in sorted(layouts.items())] + [(p, True, mark("text", p, t)) for p, t in texts]


def main_text(page: str | None, known: dict[int, float] | None = None, threshold: float = 0.25, priors: bool = True) -> str:
    """Text of the page's blocks whose importance reaches the threshold.

    known: presentation by mark("path", path), content by mark("content", path), and content by
    mark("text", path, text) of texts that repeat; what is not there is neutral, or new. If no block
    reaches the threshold, those of the highest importance stay, unless all are hidden.
    """
    found = blocks(page)
    if not found:
        return ""
    known = known or {}
    total, articles = sum(len(b.text) for b in found), sum(len(b.text) for b in found if b.element.main)
    branch: dict[int, tuple[float, float]] = {}

    def judged(element: Element) -> tuple[float, float]:
        """Importance of the best branch down to this element, and the product of priors."""
        chain = []
        while element is not None and id(element) not in branch:
            chain.append(element)
            element = element.above
        weight, prior = branch[id(element)] if element is not None else (0.0, 1.0)
        for e in reversed(chain):
            share = e.chars / total
            # The page as a whole says nothing of its parts, unless it holds texts itself.
            if e.name not in ("", "html", "body") or any(x.startswith("text") for x in e.layout):
                weight = max(weight, known.get(mark("path", e.path), NEUTRAL), share)
            own = e.prior if priors or not e.prior else 1.0
            # What holds most of the articles' text, or without articles most of the page's, is no such element.
            if 0 < own < 1 and (2 * e.main_chars > articles if articles else share > (NEARLY_ALL if e.comments else MOST)):
                own = 1.0
            prior *= own
            branch[id(e)] = (weight, prior)
        return branch[id(chain[0])] if chain else (weight, prior)

    scores, contents = [], []
    for b in found:
        weight, prior = judged(b.element)
        contents.append(min(known.get(mark("content", b.element.path), 1.0), known.get(mark("text", b.element.path, b.text), 1.0)))
        scores.append(weight * prior)
    own = _main_branch(found, [branch[id(b.element)][1] >= 1 for b in found])
    lost = sum(len(b.text) for b, x, c, mine in zip(found, scores, contents, own, strict=True) if mine and x * c < threshold <= x)
    if 2 * lost > sum(len(b.text) for b, mine in zip(found, own, strict=True) if mine):
        contents = [1.0 if mine else c for c, mine in zip(contents, own, strict=True)]
    scores = [x * c for x, c in zip(scores, contents, strict=True)]
    least = min(threshold, max(scores))
    return "\n".join(b.text for b, x in zip(found, scores, strict=True) if x >= least and x > 0)


def _main_branch(found: list[Block], plain: list[bool]) -> list[bool]:
    """Which blocks are of the page's main branch; plain: those under no element that a prior counts against.

    The articles, if they hold most of the plain text. Else the deepest element around the longest plain block that
    holds most of the page's text, if it has at least a few blocks.
    """
    size = sum(len(b.text) for b, ok in zip(found, plain, strict=True) if ok)
    own = [ok and b.element.main for b, ok in zip(found, plain, strict=True)]
    if 2 * sum(len(b.text) for b, mine in zip(found, own, strict=True) if mine) > size:
        return own
    top = max((b for b, ok in zip(found, plain, strict=True) if ok), key=lambda b: len(b.text), default=None)
    if top is None:
        return own
    total, element = sum(len(b.text) for b in found), top.element
    while 2 * element.chars <= total and element.above is not None:
        element = element.above
    inside = {id(element): True}

    def within(e: Element | None) -> bool:
        chain = []
        while e is not None and id(e) not in inside:
            chain.append(e)
            e = e.above
        answer = e is not None and inside[id(e)]
        inside.update((id(x), answer) for x in chain)
        return answer

    own = [ok and within(b.element) for b, ok in zip(found, plain, strict=True)]
    return own if sum(own) >= FEW else [False] * len(own)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class SiteStyleTree:
    """threshold: importance under which a block goes; prior: pages that the same path over all hosts
    counts for; small: names (16 bytes each) of the tree up to which every worker gets it whole."""

    def __init__(self, threshold: float = 0.25, prior: float = 10.0, small: int = 1_000_000, tree: bool = True, priors: bool = True):
        self.threshold, self.prior, self.small, self.tree, self.priors = threshold, prior, small, tree, priors

    def nodes(self, pages: DataFrame) -> DataFrame:
        """(host, path, is_text, feature): features of each distinct page."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for url, page in zip(pdf["url"], pdf["html"], strict=True):
                    got = features(blocks(page))
                    digest = hashlib.blake2b(repr([f for _, _, f in got]).encode(), digest_size=16).digest()
                    out.append((host_of(url), digest, [p for p, _, _ in got], [f for _, _, f in got], sum(not t for _, t, _ in got)))
                yield pd.DataFrame(out, columns=["host", "digest", "paths", "features", "layouts"])

        rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInPandas(tidy(run), "host string, digest binary, paths array<string>, features array<long>, layouts int")
        once = rows.groupBy("host", "digest").agg(F.first(F.struct("paths", "features", "layouts")).alias("x"))  # copies of a page count once
        pairs = once.select("host", F.col("x.layouts").alias("layouts"), F.posexplode(F.arrays_zip("x.paths", "x.features")).alias("k", "y"))
        return pairs.select("host", F.col("y.paths").alias("path"), (F.col("k") >= F.col("layouts")).alias("is_text"), F.col("y.features").alias("feature"))

    def _counts(self, pages: DataFrame) -> DataFrame:
        return materialize(self.nodes(pages).groupBy("host", "path", "is_text", "feature").agg(F.count("*").alias("c")))

    def importance(self, counts: DataFrame) -> DataFrame:
        """(host, path, pages, presentation, content) of the merged trees, from the counts of features.

        presentation: 1 - exp(-H) of the entropy H of the path's layouts; content: one minus the
        mean of log c / log m over its texts, each on c of m pages.
        """

        def level(keys: list[str], name: str) -> DataFrame:
            by = counts.groupBy(*keys, "is_text", "feature").agg(F.sum("c").alias("c"))
            log_c = F.log(F.col("c").cast("double"))
            node = by.groupBy(*keys).agg(
                F.sum(F.when(~F.col("is_text"), F.col("c"))).alias("m"),
                F.sum(F.when(~F.col("is_text"), F.col("c") * log_c)).alias("layout_logs"),
                F.sum(F.when(F.col("is_text"), log_c)).alias("text_logs"),
                F.count(F.when(F.col("is_text"), 1)).alias("texts"),
            )
            log_m = F.log(F.col("m").cast("double"))
            shown = 1 - F.exp(F.col("layout_logs") / F.col("m") - log_m)
            said = F.when((F.col("texts") > 0) & (F.col("m") > 1), 1 - F.least(F.lit(1.0), F.col("text_logs") / F.col("texts") / log_m)).otherwise(1.0)
            return node.select(*keys, F.col("m").alias(f"{name}pages"), shown.alias(f"{name}presentation"), said.alias(f"{name}content"))

        k = self.prior
        both = level(["host", "path"], "").join(level(["path"], "all_"), "path")
        toward = lambda n, x, y: (F.col(n) * F.col(x) + k * y) / (F.col(n) + k)
        return both.select("host", "path", "pages", toward("pages", "presentation", toward("all_pages", "all_presentation", F.lit(NEUTRAL))).alias("presentation"), toward("pages", "content", toward("all_pages", "all_content", F.lit(1.0))).alias("content"))

    def known(self, pages: DataFrame) -> DataFrame:
        """(host, name, value): what main_text asks for, as far as it is not neutral.

        A text that is on more than the square root of the pages of its path counts by its own entropy.
        """
        counts = self._counts(pages)
        tree = materialize(self.importance(counts))

        def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                kinds = [("path", "presentation"), ("content", "content")]
                yield pd.concat([pd.DataFrame({"host": pdf["host"], "name": [mark(k, p) for p in pdf["path"]], "value": pdf[c]}) for k, c in kinds], ignore_index=True)

        paths = tree.mapInPandas(named, "host string, name long, value double").where("value < 0.999 OR value IS NULL")
        size = tree.select("host", "path", "pages")
        texts = counts.where("is_text AND c > 2").join(size, ["host", "path"]).where(F.col("c") * F.col("c") > F.col("pages"))
        texts = texts.select("host", F.col("feature").alias("name"), (1 - F.log(F.col("c").cast("double")) / F.log(F.col("pages").cast("double"))).alias("value"))
        return materialize(paths.unionByName(texts))

    def transform(self, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
        """(page_id, url, text, n_chars), one row per input row; other columns don't matter.

        A null or empty page has the empty text. Pages without a usable url are one host. An
        article's own header belongs to it. An empty table gives an empty result, repeated rows
        repeated results.
        """
        spark = pages.sparkSession
        text_batches(spark)
        threshold, priors = self.threshold, self.priors
        rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
        known = self.known(pages) if self.tree else None
        shape = "page_id long, url string, text string, n_chars long"

        def answer(pdf: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

        if known is None or known.count() <= self.small:
            table: dict[str, dict[int, float]] = {}
            for r in known.collect() if known is not None else []:  # bounded by `small`, which was just counted
                table.setdefault(r["host"], {})[r["name"]] = r["value"]
            held = spark.sparkContext.broadcast(table)

            def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    yield answer(pdf, [main_text(h, held.value.get(host_of(u)), threshold, priors) for h, u in zip(pdf["html"], pdf["url"], strict=True)])

            return rows.mapInPandas(tidy(whole), shape)

        def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                names = []
                for page in pdf["html"]:
                    got = features(blocks(page))
                    names.append([mark(k, p) for p, t, _ in got if not t for k in ("path", "content")] + [f for _, t, f in got if t])
                yield pd.DataFrame({"host": [host_of(u) for u in pdf["url"]], "k1": pdf["k1"], "k2": pdf["k2"], "names": names})

        # A large tree is not sent around: every distinct page fetches its own names, by shuffle.
        keyed = rows.withColumns({"k1": F.xxhash64("url", "html"), "k2": F.hash("html", "url")})
        asked = keyed.select("url", "html", "k1", "k2").mapInPandas(tidy(asks), "host string, k1 long, k2 int, names array<long>")
        asked = asked.select("host", "k1", "k2", F.explode("names").alias("name")).distinct().join(known, ["host", "name"])
        own = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("name", "value")).alias("own"))  # of one page

        def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                tables = [{x["name"]: x["value"] for x in own} if own is not None else {} for own in pdf["own"]]
                yield answer(pdf, [main_text(h, t, threshold, priors) for h, t in zip(pdf["html"], tables, strict=True)])

        return keyed.join(own, ["k1", "k2"], "left").select("page_id", "url", "html", "own").mapInPandas(tidy(apart), shape)
