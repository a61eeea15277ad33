"""Main text of web pages by paths that the pages of a host agree on."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices, strings, table

#: Winning paths of up to so many hosts go to every task as one small table.
MOST_BROADCAST = 50_000
# Elements by what they do in a page (fixed values)
CONTAINERS = frozenset("html head body main article section div header footer nav aside form figure table tbody thead tr td th ul ol dl center details dialog menu fieldset blockquote".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address caption figcaption summary legend option".split())
BLOCKS = CONTAINERS | TEXT_BLOCKS | frozenset("hr br title".split())
#: Their content is no markup, up to their end tag or that of the page.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Controls and drawings, whose content is left out if they are closed somewhere.
CONTROLS = frozenset("svg select button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: They end where the next one starts, or what they are in ends.
IMPLIED_END = frozenset("p li dt dd option".split())
BOILERPLATE = frozenset("head header footer nav aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a class, id or role name that mark what is not the article.
NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login menu menubar nav navbar navigation topnav breadcrumb breadcrumbs sidebar aside widget widgets related recommended "
    "recommendations share sharing social comment comments disqus discussion respond reply replies footer header masthead topbar pagination pager search hidden copyright "
    "complementary contentinfo".split()
)
#: Of headings these tell where they are, not what they are.
OF_HEADINGS = frozenset("header banner masthead".split())
TEXTUAL = frozenset("article content main post entry story body text".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)")
HOLDS_ARTICLE = re.compile(r"<(?:article|main|h1)\b", re.IGNORECASE)
HEADING = re.compile(r"<h[1-6]\b", re.IGNORECASE)
#: Words beside those of NOT_TEXT that tell only where something stands or what it is made of.
LAYOUT = frozenset(
    "area bar block box bottom button buttons card cards column container content div form global group header heading icon icons inner item items left line link links list "
    "main module outer page panel post posts primary right row secondary section site small text the title top unit wrap wrapper article articles".split()
)
#: Elements that take all that follows if they are not closed.
SWALLOWS = frozenset(("script", "style"))
DIGITS = re.compile(r"\d+")
WORD = re.compile(r"[a-z]+")


class Page:
    """Elements in order of their start tags, each by its number: where it stands, whether it counts, how much text it has.

    A path is a number, too; `paths` has that of each pair of a path and a
    further step, so that nothing grows with the square of the depth.
    """

    def __init__(self):
        self.parent, self.tag, self.path, self.out, self.textual = [-1], [""], [0], [False], [False]
        self.own, self.linked = [0], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(-1, "")]
        #: (element, text, whether a block ends before it)
        self.pieces: list[tuple[int, str, bool]] = []

    def add(self, parent: int, tag: str, step: str, out: bool, textual: bool) -> int:
        key = (self.path[parent], step)
        number = self.paths.get(key)
        if number is None:
            number = self.paths[key] = len(self.steps)
            self.steps.append(key)
        for column, value in zip((self.parent, self.tag, self.path, self.out, self.textual, self.own, self.linked), (parent, tag, number, out, textual, 0, 0), strict=True):
            column.append(value)
        return len(self.parent) - 1

    def path_text(self, element: int) -> str:
        out, at = [], self.path[element]
        while at > 0:
            at, step = self.steps[at]
            out.append(step)
        return "".join(f"/{step}" for step in reversed(out))

    def path_number(self, text: str) -> int | None:
        at = 0
        for step in text.split("/")[1:]:
            at = self.paths.get((at, step))
            if at is None:
                return None
        return at


def _attributes(text: str) -> tuple[list[str], list[str], bool]:
    """The class names, the names of id and role, and whether the element is hidden."""
    classes, names, hidden = [], [], False
    for m in ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class":
            classes += value.lower().split()
        elif key in ("id", "role"):
            names += value.lower().split()
        elif key == "hidden" or (key == "style" and NO_DISPLAY.search(value)):
            hidden = True
    return classes, names, hidden


def _marked(tag: str, classes: list[str], names: list[str]) -> bool:
    """Whether the names say that an element is not of the article."""
    if tag in ("html", "body"):
        return False
    # what is called an article is left out only for a whole name: "category-social" tells what it is about
    if tag in ("article", "main") or any(n in TEXTUAL for n in (*classes, *names)):
        return any(n in NOT_TEXT for n in (*classes, *names))
    words = NOT_TEXT - OF_HEADINGS if tag in HEADINGS else NOT_TEXT

    def whole(name: str) -> bool:
        # ids are often made of a heading: "search-algorithms" is no search form, "search-box" is
        parts = WORD.findall(name)
        return any(w in words for w in parts) and all(w in words or w in LAYOUT for w in parts)

    def part(name: str) -> bool:
        # "has-sidebar" tells about a neighbour
        return not name.startswith(("has", "with", "no-")) and any(w in words for w in WORD.findall(name))

    return any(map(whole, names)) or any(map(part if tag in CONTAINERS else whole, classes))


def _raw_end(source: str, tag: str, at: int) -> int:
    """Where an element whose content is no text ends, templates with those in them; -1 if nowhere."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).finditer(source, at):
        depth += -1 if m[1] else (tag == "template")
        if not depth:
            return m.end()
    return -1


def _left_out(tag: str, attributes: str) -> bool:
    classes, names, hidden = _attributes(attributes)
    return hidden or _marked(tag, classes, names)


class Places:
    """Where patterns are in a page; each is looked for once, in one run."""

    def __init__(self, source: str):
        self.source, self.held = source, {}

    def any_in(self, pattern: re.Pattern, start: int, end: int) -> bool:
        if pattern not in self.held:
            self.held[pattern] = [m.start() for m in pattern.finditer(self.source)]
        k = bisect_left(self.held[pattern], start)
        return k < len(self.held[pattern]) and self.held[pattern][k] < end

    def next_end(self, tag: str, start: int) -> int:
        """The next end tag of that name; -1 if there is none."""
        if "" not in self.held:
            ends = self.held[""] = {}
            for m in END_TAG.finditer(self.source):
                ends.setdefault(m[1].lower(), []).append(m.start())
        ends = self.held[""].get(tag, ())
        k = bisect_left(ends, start)
        return ends[k] if k < len(ends) else -1


def parse(source: str) -> Page:
    """The elements of a page and its text, in one run over the tags.

    Containers stand in a stack; other elements only where their names mark
    them. An end tag closes the last open element of its name and what is open
    in it. An element that is left out but is closed nowhere is not opened, so
    that it takes nothing with it.
    """
    page = Page()
    stack, at, n, fresh, linked = [0], 0, len(source), True, 0
    #: Of the marked elements in the stack that are no containers: elements of the same name that are open in them.
    within: dict[int, int] = {}
    open_ = Counter()
    places, last_tag = Places(source), source.rfind(">")

    def text(start: int, end: int) -> None:
        nonlocal fresh
        if start < end:
            piece = html.unescape(source[start:end])
            if not piece.isspace():
                top = stack[-1]
                page.pieces.append((top, piece, fresh))
                size = len(piece.strip())
                page.own[top] += size
                page.linked[top] += size * (linked > 0)
                fresh = False
            elif page.pieces and not fresh:
                page.pieces.append((stack[-1], " ", False))

    def closed(tag: str, place: int) -> bool:
        return places.next_end(tag, place) >= 0

    def pop(place: int) -> None:
        for element in stack[place:]:
            open_[page.tag[element]] -= 1
            within.pop(element, None)
        del stack[place:]

    def close(tag: str) -> None:
        if open_[tag] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if page.tag[stack[i]] == tag:
                    pop(i)
                    return

    def push(tag: str, step: str, out: bool, textual: bool = False) -> int:
        stack.append(page.add(stack[-1], tag, step, out, textual))
        open_[tag] += 1
        return stack[-1]

    last = 0
    while at < n:
        at = source.find("<", at)
        # after the last '>' there are no tags
        if at < 0 or at > last_tag:
            break
        if source.startswith("<!--", at):
            text(last, at)
            end = source.find("-->", at + 4)
            at = last = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), at):
            text(last, at)
            end = source.find(">", at)
            at = last = n if end < 0 else end + 1
            continue
        m = TAG.match(source, at)
        if not m:
            at += 1
            continue
        text(last, at)
        closing, tag, rest = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        at = last = m.end()
        empty = rest.endswith("/") or tag in VOID
        top = stack[-1]
        if tag in RAW:
            if not closing and not empty:
                end = _raw_end(source, tag, at) if tag in SWALLOWS or closed(tag, at) else -1
                # without an end, a script or style takes all that follows, as in browsers; others take nothing
                at = last = end if end >= 0 else n if tag in SWALLOWS else at
            continue
        if tag in BLOCKS:
            fresh = True
            # a marked paragraph or item ends where the next block starts
            if top in within and not closing and (page.tag[top] == "p" or (page.tag[top] == tag and tag in IMPLIED_END)):
                pop(len(stack) - 1)
                top = stack[-1]
        if tag == "a":
            linked = 0 if closing else 1
        if tag in CONTAINERS:
            linked = 0
            if closing:
                close(tag)
                continue
            classes, names, hidden = _attributes(rest) if rest else ([], [], False)
            marked = hidden or (bool(classes or names) and _marked(tag, classes, names))
            out = tag in BOILERPLATE or marked
            if out and not closed(tag, at):
                continue
            if out and not marked:
                # some sites hold the whole page in one form, and an article's header holds its headings
                holds = HOLDS_ARTICLE if tag == "form" else HEADING if tag == "header" and open_["article"] + open_["main"] > 0 else None
                out = not (holds and places.any_in(holds, at, places.next_end(tag, at)))
            step = ".".join([tag, *sorted({DIGITS.sub("#", c).replace("/", "|") for c in classes})])
            textual = tag in ("article", "main") or any(w in TEXTUAL for c in (*classes, *names) for w in WORD.findall(c))
            push(tag, step, page.out[top] or out, textual)
            if empty and tag != "body":
                pop(len(stack) - 1)
        elif top in within and page.tag[top] == tag:
            within[top] += -1 if closing else (not empty)
            if within[top] < 0:
                pop(len(stack) - 1)
        elif closing:
            if tag in CONTROLS or open_[tag] > 0:
                close(tag)
        elif not empty and (tag in CONTROLS or (rest and _left_out(tag, rest))) and (closed(tag, at) or tag in IMPLIED_END):
            within[push(tag, tag, True)] = 0
    text(last, n)
    return page


def scores(page: Page) -> list[int]:
    """Of each element: the text right below it counts in full, that of the next levels by halves; links do not, names of articles do."""
    got = [0.0] * len(page.parent)
    for i, (own, linked) in enumerate(zip(page.own, page.linked, strict=True)):
        share, at = float(max(0, own - 2 * linked)), i
        while share >= 1 and at >= 0:
            if not page.out[i]:
                got[at] += share
            share, at = share / 2, page.parent[at]
    for i, out in enumerate(page.out):
        got[i] = 0 if out or i == 0 else got[i] * (4 if page.tag[i] in ("article", "main") else 1.5 if page.textual[i] else 1)
    return [int(x) for x in got]


def totals(page: Page) -> tuple[list[int], list[int], list[int]]:
    """Of each element the characters below it: outside links, in links, and those outside links in articles; what is left out has none."""
    n = len(page.parent)
    plain, linked, articles = [0] * n, [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        if page.out[k]:
            continue
        plain[k] += page.own[k] - page.linked[k]
        linked[k] += page.linked[k]
        up = page.parent[k]
        plain[up] += plain[k]
        linked[up] += linked[k]
        articles[up] += plain[k] if page.tag[k] == "article" else articles[k]
    return plain, linked, articles


def best_element(page: Page) -> tuple[int, int]:
    """The element of the article and its score; 0 if none has text.

    From the one with the highest score, the first of equal ones, it goes up
    as long as what a parent holds besides is text, too, more of it outside
    links than in them. Above an article that must be mostly other articles,
    above a main element nothing is.
    """
    got = scores(page)
    i = max(range(len(got)), key=lambda k: (got[k], -k))
    if got[i] <= 0:
        return 0, 0
    plain, linked, articles = totals(page)
    best, at = got[i], i
    while page.tag[at] != "main" and page.parent[at] > 0:
        up = page.parent[at]
        more, links = plain[up] - plain[at], linked[up] - linked[at]
        if page.tag[at] == "article" or page.tag[i] == "article":
            of_articles = articles[up] - (plain[at] if page.tag[at] == "article" else articles[at])
            if 2 * of_articles < more or (more and not of_articles):
                break
        elif links > more or page.tag[up] in ("html", "body") and not more:
            break
        # a wrapper that adds nothing is passed on the way to one that does
        if more:
            i = up
        at = up
    return i, best


def best_path(page: Page) -> tuple[str, int]:
    i, score = best_element(page)
    return page.path_text(i), score


def main_text(page: Page, path: str | None) -> str:
    """The text below the elements of a path, or of the page's own best one if it has no text there."""
    plain, linked, _ = totals(page)
    for wanted in (page.path_number(path) if path else None, page.path[best_element(page)[0]]):
        if not wanted:
            continue
        # a menu may stand on the article's path, too
        told = any(page.path[i] == wanted and plain[i] >= max(1, linked[i]) for i in range(len(plain)))
        inside = [False] * len(page.parent)
        for i in range(1, len(inside)):
            inside[i] = not page.out[i] and (inside[page.parent[i]] or (page.path[i] == wanted and (plain[i] >= linked[i] or not told)))
        parts: list[str] = []
        for at, piece, fresh in page.pieces:
            if inside[at]:
                parts += [" ", piece] if fresh else [piece]
            elif parts:
                # what is left out inside a line leaves its place
                parts.append(" " if fresh else "")
        found = " ".join("".join(parts).split())
        if found:
            return found
    # a page without containers, or whose text is right below the root
    if not path and not any(own for own, out in zip(page.own[1:], page.out[1:], strict=True) if not out):
        return " ".join("".join((" " if fresh else "") + piece for at, piece, fresh in page.pieces if at == 0).split())
    return ""


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most pages of a host vote for; of equal ones that of the higher sum of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            votes: dict[tuple[str, str], list[int]] = {}
            for host, source in zip(batch.column("host").to_pylist(), strings(batch.column("html")), strict=True):
                path, score = best_path(parse(source))
                if path:
                    own = votes.setdefault((host, path), [0, 0])
                    own[0] += 1
                    own[1] += score
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), *(pa.array([v[i] for v in votes.values()], pa.int64()) for i in (0, 1))],
                ["host", "path", "votes", "score"],
            )

    counted = pages.select("host", "html").mapInArrow(run, "host string, path string, votes long, score long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, path, text): the main text of each page.

    Each page's containers are scored by the text below them; each page votes
    for the generalised path (tags and classes, digits as #) of its best one,
    and all its pages are read again by the path that wins at their host. A
    page without text there uses its own best container. Menus, headers,
    footers, sidebars, notices, adverts, forms and comments are left out by
    element and by class, id or role, also single paragraphs, items, headings
    and inline elements, and what is hidden; a form around an article and the
    header in one that holds a heading are not. Of ids, and of classes of what is
    no container, the whole name must say so: "related-work" is a heading's.
    What an element without end tag would leave out stays, but for scripts and
    styles. Time and memory are in proportion to the page, whatever its markup. Character references are decoded,
    white space in a block is one space, blocks are joined by one space.

    Null html counts as empty, with empty text; null url and urls without a
    host share one host; repeated rows stay; an empty table gives no rows;
    further columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.col("html").cast("string"),
        F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")).alias("host"),
    )
    paths = cut(host_paths(rows))
    if paths.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        paths = F.broadcast(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(parse(source), path) for source, path in zip(strings(batch.column("html")), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "path")), pa.array(texts, pa.string())], ["page_id", "url", "path", "text"])

    return rows.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, path string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_html": op5_html}
SQL: dict[str, str] = {}
