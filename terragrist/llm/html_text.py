"""Main text of web pages by composite text density (after Sun, Song and Liao, 2011).

A small tolerant parser builds the tree of a page with implied end tags. Parts that are no article by their tag, class, id or
visibility are cut, but no part goes for its name alone that holds an article or most of the page's text. Every remaining node gets a density: characters per tag, lowered where much of the text is link
text. The container whose children's densities have the largest sum is the core; the threshold is the least density on
its path to the body, and what hangs off that path with at least that density belongs to the text too.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"/?[a-zA-Z][^\s/<>\"']*")
_STOP, _QUOTED_STOP = re.compile(r"[<>]"), re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Names of HTML elements by the part they play in parsing; fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open p.
ENDS_P = BLOCK - frozenset("body html head td th tr caption tbody thead tfoot".split())
#: Start tags that end open elements of these names, up to a container that bounds the search.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Elements that hold no article text.
CUT = frozenset("head script style noscript template nav footer aside button select option textarea input iframe object embed svg canvas audio video map dialog menu".split())
#: Words of class, id and role names of parts that are no article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar aside menu navbar nav navigation navigationbar breadcrumb breadcrumbs header masthead footer "
    "comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager "
    "toolbar widget copyright legal disclaimer complementary contentinfo search skip".split()
)
#: Words that only say where or how such a part stands: a name of these and words of NOISE is noise, as `comment-list`; `has-sidebar` is not.
PLACES = frozenset("list area box wrapper wrap container section block item items inner outer body bar top bottom left right site main page post posts links text title group row".split())
#: Elements within a line, and those that hold lines: what is within a line of these is never cut for its name.
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
LINES = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 blockquote pre caption figcaption".split())
#: Elements that are cut unless they hold an article or most of the text, as parts with a name of noise.
MOSTLY = frozenset("form fieldset label".split())
#: Elements that may be the core: containers, no paragraphs or inline parts.
CONTAINER = frozenset("html body article main section div td blockquote center figure details ul ol dl table tbody tr span #root".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Page:
    """Nodes in page order; a parent always comes before its children."""

    def __init__(self) -> None:
        self.tag, self.parent, self.cut, self.texts = ["#root"], [-1], [False], []
        # cut in any case; named as noise; a marked article
        self.hard, self.named, self.marked = [False], [False], [False]
        # inside an article; inside a header of one and no heading; in a line of an element of LINES
        self.inside, self.header, self.line = [False], [False], [False]
        self.block = 0

    def add(self, tag: str, parent: int, hard: bool, named: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.cut.append(False)
        self.hard.append(hard or self.hard[parent])
        self.line.append(tag in LINES or tag in INLINE and self.line[parent])
        in_line = tag in INLINE and self.line[parent] or tag in ("td", "th", "tr")
        self.named.append(named and not in_line and tag not in ("article", "main", *HEADINGS))
        self.marked.append(tag in ("article", "main") and not named and not self.hard[-1])
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        self.header.append(tag not in HEADINGS and (tag == "header" or self.header[parent]))
        return len(self.tag) - 1


def _is_noise(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is cut in any case, and whether its name says that it is no article."""
    if tag in CUT or tag == "header" and not in_article:
        return True, True
    named = tag in MOSTLY
    if not attributes or tag in ("html", "body"):
        return False, named
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, True
        if name in ("class", "id", "role") and not named:
            words = ({w for w in re.split(r"[^a-z]+", token) if w} for token in value.split())
            named = any(not NOISE.isdisjoint(w) and w <= NOISE | PLACES for w in words)
    return False, named


def _settle(page: _Page) -> None:
    """Cuts the named parts, but none that holds text of a marked article, or most of the page's text outside of links, while no article stands elsewhere."""
    n = len(page.tag)
    in_link, in_marked = [False] * n, list(page.marked)
    own, marked, below = [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
        in_marked[i] = in_marked[i] or in_marked[page.parent[i]]
    for node, _, piece in page.texts:
        if not page.hard[node] and not in_link[node]:
            size = len("".join(piece.split()))
            own[node] += size
            marked[node] += size if in_marked[node] else 0
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        own[p] += own[i]
        marked[p] += marked[i]
        below[p] = below[p] or below[i] or page.marked[i] and own[i] > 0
    for i in range(1, n):
        most = 2 * own[i] > own[0] and 4 * (marked[0] - marked[i]) < own[i]
        page.cut[i] = page.cut[page.parent[i]] or page.hard[i] or page.named[i] and not below[i] and not most


class _Markup:
    """One pass over the markup of a page. Comments, declarations and instructions end at their own marks, or with the page.

    A tag ends at the first `>` outside of quotes; where quotes do not close, or a `<` stands outside of them, at the next `>` before any
    `<`. A `<` that starts none of these is text. Steps through quotes that end in no tag are counted, and once they
    cost more than four passes over the page, quotes are not looked at any more; so time stays in proportion to the page.
    """

    def __init__(self, source: str) -> None:
        self.source, self.at, self.last, self.spent = source, 0, source.rfind(">"), 0

    def next(self) -> tuple[str, str, str, bool]:
        """(text before, name of the tag, its attributes, whether this was the last piece); the name is empty where there is no tag."""
        source, done, at = self.source, self.at, self.at
        while (at := source.find("<", at)) >= 0:
            after = source[at + 1 : at + 2]
            if after in ("!", "?"):
                mark = "-->" if source.startswith("<!--", at) else ">"
                end = source.find(mark, at + 2 if mark == ">" else at + 4)
                self.at = len(source) if end < 0 else end + len(mark)
                return source[done:at], "", "", False
            name = _NAME.match(source, at + 1) if at < self.last else None
            if name:
                end = self._end(name.end())
                if end >= 0:
                    self.at = end + 1
                    return source[done:at], name[0].lower(), source[name.end() : end], False
            at += 1
        self.at = len(source)
        return source[done:], "", "", True

    def _end(self, start: int) -> int:
        """The place of the `>` of a tag, or -1."""
        source, at = self.source, start
        while self.spent <= 4 * len(source):
            m = _QUOTED_STOP.search(source, at)
            if m and m[0] == ">":
                return m.start()
            close = source.find(m[0], m.end()) if m and m[0] != "<" else -1
            if close < 0:
                self.spent += (len(source) if m and m[0] != "<" else at) - start
                break
            at = close + 1
        m = _STOP.search(source, start)
        return m.start() if m and m[0] == ">" else -1

    def jump(self, end: int) -> None:
        self.at = end


def parse(source: str) -> _Page:
    page, stack = _Page(), [0]
    # depths of the open elements of each name, and of all open blocks
    open_: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []

    def text(piece: str) -> None:
        if piece:
            page.texts.append((stack[-1], page.block, piece))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            name = page.tag[stack.pop()]
            open_[name].pop()
            if name in BLOCK:
                blocks.pop()
                page.block += 1

    deepest = lambda names: max((open_[x][-1] for x in names if open_[x]), default=0)
    markup, ended = _Markup(source), False
    while not ended:
        piece, tag, attributes, ended = markup.next()
        text(piece)
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            # an inline end tag does not close blocks
            if open_[tag] and (tag in BLOCK or not blocks or open_[tag][-1] > blocks[-1]):
                pop_to(open_[tag][-1])
            continue
        if tag == "br":
            text(" ")
        if tag in ENDS_P and blocks and page.tag[stack[blocks[-1]]] == "p":
            pop_to(blocks[-1])
        if tag in IMPLIED:
            names, bounds = IMPLIED[tag]
            if deepest(names) > deepest(bounds):
                pop_to(deepest(names))
        if tag == "body" and open_["head"]:
            pop_to(open_["head"][0])
        hard, named = _is_noise(tag, attributes, page.inside[stack[-1]])
        if tag in BLOCK:
            page.block += 1
        node = page.add(tag, stack[-1], hard, named)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(source, markup.at)
            end = source.find(">", close.end()) if close else -1
            markup.jump(end + 1 if end >= 0 else len(source))
            continue
        open_[tag].append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(node)
    _settle(page)
    return page


def _densities(page: _Page) -> tuple[list[float], list[float]]:
    """Composite density of each node and the sum over its children."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
    for node, _, piece in page.texts:
        if not page.cut[node]:
            size = len(piece) if "&" not in piece else len(html.unescape(piece))
            chars[node] += size
            link_chars[node] += size if in_link[node] else 0
    for i in range(n - 1, 0, -1):
        if not page.cut[i]:
            p = page.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    share = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], max(1, link_tags[i])
        if c and not page.cut[i]:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / t * math.log(c / max(1, lc) * (t / lt) + 1) / math.log(base + math.e)
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    return density, total


def main_text(source: str) -> str:
    """Text of the article, one line a block."""
    page = parse(source)
    density, total = _densities(page)
    n = len(page.tag)
    cores = [i for i in range(n) if not page.cut[i] and page.tag[i] in CONTAINER and density[i] > 0]
    if not cores:
        return ""
    core = max(cores, key=lambda i: (total[i], i))
    # a marked article or main part around the core is taken whole
    path, node = [], core
    while node >= 0:
        path.append(node)
        node = page.parent[node]
    core = next((i for i in path if page.tag[i] in ("article", "main")), core)
    path = path[path.index(core) :]
    inner = [i for i in path if page.tag[i] not in ("html", "#root")] or path
    threshold = min(density[i] for i in inner)
    on_path, chosen = set(path), [False] * n
    chosen[core] = True
    for i in range(1, n):
        p = page.parent[i]
        chosen[i] = chosen[i] or chosen[p] or (p in on_path and i not in on_path and density[i] >= threshold and page.tag[i] not in ("html", "body"))
    blocks: dict[int, list[str]] = {}
    for node, block, piece in page.texts:
        if chosen[node] and not page.cut[node] and not page.header[node] or node == 0 and core == 0:
            blocks.setdefault(block, []).append(piece)
    lines = (" ".join(html.unescape("".join(b)).split()) for _, b in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages`, from its whole html.

    Null and empty html, and pages without article text, give an empty text. Repeated rows are each answered; ids and urls may
    be null; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) if x.is_valid else "" for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
