"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text that is left in them once menus, forms, adverts and the
like are out; the page votes for the generalised path (tags with classes, numbers masked) of the
smallest container that holds most of it, widened to all text of the main or article element around it.
A form, or a part that a class or id alone marks as boilerplate, stays in if it holds most of the page's
text; whole pages lie in forms.

Votes are counted per host in Spark, beside how many pages have each of these paths at all, and every
page is extracted again from the containers on its host's winning paths, best first. A page with a best
container of its own keeps it, unless its path is one that the host's pages choose less often, where
they have it, than the winner's. So a page with little text of its own still gets the container that its
host's other pages agree on, and a page of another template keeps its article. If the host has not
ranked the page's own path, a shorter text of the winner is joined with the page's own. Headings and
paragraphs that lie beside a container, in no other one, belong to it.

A block is a block-level element's own text. White space in a block becomes one space, blocks are
joined in page order by an empty line. Character references are decoded. A line break element is
white space.

Null or empty html gives the empty text. Pages without a url, or with one that has no host, share the
empty host. Repeated pages vote and are extracted each. Paths with equal votes are taken in the order
of the path. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltframe.session import new_table_path

#: Winning paths kept per host.
WINNERS = 3
#: Share of a page's text that a container must hold to stand for the page.
SHARE = 0.7

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head title script style noscript template svg math canvas iframe object nav footer aside button "
    "select option textarea input label dialog menu audio video".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table "
    "thead tbody tfoot tr td th caption header footer nav aside form fieldset address details summary hr center".split()
)
CONTAINERS = frozenset("body main article section div td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never are boilerplate because of their class alone.
TRUSTED = frozenset("html body main article".split())
#: A longer path is told by a hash of its beginning, so that deep pages stay small.
LONGEST_PATH = 512
#: Parts of class names and ids of what is not the article.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert alerts nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "sidebars aside rail comment comments disqus respond reply replies footer masthead topbar share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup signin login search pagination pager "
    "popup modal overlay widget widgets toolbar copyright disclaimer form forms".split()
)
CLOSED_BY_BLOCK = frozenset(("p",))
SIBLINGS = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
}
BARRIERS = frozenset("ul ol dl table article section div main body html".split())
_NAMES = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\d+")


def _unwanted(names: str) -> bool:
    """If a class or id has an unwanted word first or last among its parts."""
    for name in names.lower().split():
        parts = _NAMES.findall(name)
        if parts and (parts[0] in UNWANTED or parts[-1] in UNWANTED):
            return True
    return False


# The start of a comment, a declaration, or a tag with its attributes, whose quoted values may hold anything. What a
# tag has taken is not given back, so a tag costs one pass; if its quotes leave no end, it ends at the next ">".
MARKUP = re.compile(
    r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?=>)|[^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is text up to their end tag.
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}


class Page:
    """The containers and the blocks of one page."""

    def __init__(self, html: str):
        self._parse(html, frozenset())
        half = (sum(max(0, len(t) - n) for _, t, n in self.blocks) + self.marked_text) / 2
        if spared := frozenset(n for n, size in self.marked.items() if size > half):
            self._parse(html, spared)

    def _parse(self, html: str, spared: frozenset[int]) -> None:
        self.tags, self.parents, self.paths, self.states = ["#"], [-1], [""], [""]
        self.open = [0]
        self.counts: Counter[str] = Counter()  # of open tags
        self.blocks: list[tuple[int, str, int]] = []
        self.words: list[str] = []
        self.linked = 0
        self.links = 0
        # Nodes that are out by their class or id alone, with the text in each that is no link.
        self.spared = spared
        self.marked: dict[int, int] = {}
        self.marked_open: list[int] = []
        self.marked_above: dict[int, int] = {}
        self.marked_text = 0
        self._read(html)
        self._end_block()
        # The text of a marked node is that of the marked nodes in it, too.
        for node, above in sorted(self.marked_above.items(), reverse=True):
            if above >= 0:
                self.marked[above] += self.marked[node]

    def _read(self, html: str) -> None:
        at = 0
        # Behind the last ">" no tag can end.
        last = html.rfind(">") + 1
        while found := MARKUP.search(html, at, last):
            if found.start() > at:
                self.handle_data(html[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                if found[0] == "<!--":
                    end = html.find("-->", at)
                    at = end + 3 if end >= 0 else len(html)
                continue
            tag = tag.lower()
            if found[1]:
                self.handle_endtag(tag)
                continue
            attributes = found[3]
            self.handle_starttag(tag, attributes)
            if tag in RAW:
                end = RAW[tag].search(html, at)
                at = end.end() if end else len(html)
                self.handle_endtag(tag)
            elif attributes.endswith("/") and tag not in VOID and tag not in BLOCKS:
                self.handle_endtag(tag)
        rest = html[at:].partition("<!--")[0]
        if rest:
            self.handle_data(rest)

    def _end_block(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.blocks.append((self.open[-1], text, self.linked))
            self.words, self.linked = [], 0

    def _pop(self, count: int) -> None:
        for node in self.open[count:]:
            self.links -= self.tags[node] == "a"
            self.counts[self.tags[node]] -= 1
            if self.marked_open and self.marked_open[-1] >= node:
                self.marked_open.pop()
        del self.open[count:]

    def handle_starttag(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.words.append(" ")
        if tag in BLOCKS:
            self._end_block()
            self._close_implied(tag)
        if tag in VOID:
            return
        values = {}
        if attributes:
            for k, a, b, c in ATTRIBUTE.findall(attributes):
                values.setdefault(k.lower(), unescape(a or b or c))
        names = f"{values.get('class', '')} {values.get('id', '')}" if values else ""
        above = self.states[self.open[-1]]
        state = above
        if above != "out":
            if tag in SKIPPED or "hidden" in values or values.get("role") in ("navigation", "banner", "search", "contentinfo"):
                state = "out"
            elif tag == "form" or names and self._marked(tag, names, values.get("class", "")):
                node = len(self.tags)
                if node not in self.spared:
                    state = "marked"
                    self.marked[node] = 0
                    self.marked_above[node] = self.marked_open[-1] if self.marked_open else -1
                    self.marked_open.append(node)
            elif tag == "header" and state != "marked":
                state = "headings" if self.counts["article"] or self.counts["main"] else "out"
        kind = tag
        if "class" in values:
            kind = ".".join((tag, *sorted(_NUMBER.sub("#", n) for n in values["class"].split())))
        path = self.paths[self.open[-1]]
        if len(path) > LONGEST_PATH:
            path = f"~{hashlib.blake2b(path.encode(), digest_size=16).hexdigest()}"
        self.tags.append(tag)
        self.counts[tag] += 1
        self.parents.append(self.open[-1])
        self.paths.append(f"{path}/{kind}")
        self.states.append(state)
        self.open.append(len(self.tags) - 1)
        self.links += tag == "a"

    def _marked(self, tag: str, names: str, classes: str) -> bool:
        if tag == "article":
            return _unwanted(classes) and self.counts["article"] > 0
        return tag not in TRUSTED and _unwanted(names)

    def _close_implied(self, tag: str) -> None:
        if tag == "body":
            self._pop(max((i + 1 for i, n in enumerate(self.open) if self.tags[n] == "html"), default=1))
            return
        closed = SIBLINGS.get(tag, frozenset()) | CLOSED_BY_BLOCK
        for i in range(len(self.open) - 1, 0, -1):
            if not any(self.counts[t] for t in closed):
                break
            own = self.tags[self.open[i]]
            if own in closed:
                self._pop(i)
            elif own in BARRIERS and own not in ("table",):
                break

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        if not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[i]] == tag:
                self._pop(i)
                return

    def handle_data(self, data: str) -> None:
        node = self.open[-1]
        state = self.states[node]
        if state == "out" or state == "headings" and not any(self.counts[h] for h in HEADINGS):
            return
        if state == "marked":
            size = 0 if self.links else len(data.strip())
            self.marked_text += size
            self.marked[self.marked_open[-1]] += size
            return
        self.words.append(unescape(data) if "&" in data else data)
        if self.links:
            self.linked += len(data.strip())

    def scores(self, links: bool = False) -> dict[int, int]:
        """Text in each container, without that of links or with it."""
        sizes: dict[int, int] = {}
        for node, text, linked in self.blocks:
            sizes[node] = sizes.get(node, 0) + (len(text) if links else max(0, len(text) - linked))
        # A node's number is higher than its parent's.
        for node in range(len(self.parents) - 1, 0, -1):
            if node in sizes and self.parents[node] > 0:
                sizes[self.parents[node]] = sizes.get(self.parents[node], 0) + sizes[node]
        return {n: size for n, size in sizes.items() if n > 0 and self.tags[n] in CONTAINERS}

    def scope(self, node: int) -> int:
        """The outermost main or article element that holds this container or is it, or 0."""
        found = 0
        while node > 0:
            if self.tags[node] in ("main", "article"):
                found = node
            node = self.parents[node]
        return found

    def best(self) -> int:
        """The container that stands for the page: an article with most of the text, or else the
        smallest container with most of it; inside a main or article element, the smallest around that
        with all text of the element. 0, the whole page, if there is no text."""
        scores = self.scores()
        total = max(scores.values(), default=0)
        if not total:
            return 0
        full = [n for n, s in scores.items() if s >= SHARE * total]
        articles = [n for n in full if self.tags[n] == "article"]
        node = max(articles or full)
        if scope := self.scope(node):
            texts = self.scores(links=True)
            while texts.get(node, 0) < texts[scope]:
                node = self.parents[node]
        return node

    def _around(self, nodes: set[int]) -> list[bool]:
        """For each node, if it is one of these or holds one."""
        out = [n in nodes for n in range(len(self.parents))]
        for node in range(len(out) - 1, 0, -1):
            if out[node]:
                out[self.parents[node]] = True
        return out

    def _inside(self, nodes: set[int]) -> list[bool]:
        """For each node, if it is one of these or in one."""
        out = [False]
        for node in range(1, len(self.parents)):
            out.append(node in nodes or out[self.parents[node]])
        return out

    def text_of(self, nodes: set[int]) -> str:
        """The blocks in any of these containers, or beside one in no other container."""
        around, inside = self._around(nodes), self._inside(nodes)
        nearest = [0]
        for node in range(1, len(self.parents)):
            nearest.append(node if self.tags[node] in CONTAINERS else nearest[self.parents[node]])
        kept = []
        for node, text, _ in self.blocks:
            beside = around[nearest[node]] if nearest[node] else nodes
            if node > 0 and inside[node] or beside:
                kept.append(text)
        return "\n\n".join(kept)


def _vote(page: Page) -> tuple[str, float] | None:
    best = page.best()
    if not best:
        return None
    scores = page.scores()
    return page.paths[best], scores[best] / max(scores.values())


def vote(html: str) -> tuple[str, float] | None:
    """The path of the page's best container and its weight: its share of the page's text."""
    return _vote(Page(html))


def ballot(html: str) -> dict[str, float]:
    """The paths of all containers with text of the page, with the weight of the one it votes for, else 0."""
    page = Page(html)
    paths = {page.paths[n]: 0.0 for n in page.scores(links=True)}
    if found := _vote(page):
        paths[found[0]] = found[1]
    return paths


def extract(html: str, winners: list[str], shares: list[float] | None = None) -> str:
    """The text in the containers on the first winning path that has any, or in the page's best one if
    that is the better for this page. ``shares``: for each winner the votes for it by the pages that
    have it."""
    page = Page(html)
    best = page.best()
    share = dict(zip(winners, shares or [], strict=False))
    for path in winners:
        nodes = {n for n, p in enumerate(page.paths) if p == path}
        inside = page._inside(nodes)
        if not any(inside[b[0]] for b in page.blocks):
            continue
        own = page.paths[best]
        if not best or own == path:
            return page.text_of(nodes)
        if own in share:
            if share[own] > share[path]:
                return page.text_of({n for n, p in enumerate(page.paths) if p == own})
        elif len(page.text_of(nodes)) < len(page.text_of({best})):
            nodes = nodes | {best}
        if page.scope(best) and page._around(nodes)[best]:
            nodes = nodes | {best}
        return page.text_of(nodes)
    return page.text_of({best})


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, winners: int = WINNERS) -> DataFrame:
    """host, its winning paths, best first, and for each the votes for it by the pages that have it."""

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, weights = [], [], []
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                for path, weight in ballot(html.as_py() or "").items():
                    hosts.append(host.as_py())
                    paths.append(path)
                    weights.append(weight)
            yield pa.record_batch(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.float64())],
                ["host", "path", "weight"],
            )

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    votes = rows.mapInArrow(voted, "host string, path string, weight double")
    # Rounded, so that sums do not depend on the order of rows.
    counted = votes.groupBy("host", "path").agg(
        F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("votes"), F.count(F.lit(1)).alias("pages")
    )
    counted = counted.where("votes > 0")
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    first = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= winners)
    share = (F.col("votes") / (1000 * F.col("pages"))).alias("share")
    ranked = first.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path", share))).alias("ranked"))
    return ranked.select("host", F.col("ranked.path").alias("paths"), F.col("ranked.share").alias("shares"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    path = new_table_path(pages.sparkSession, "host-paths")
    host_paths(pages).write.parquet(path)
    # One small row per host: broadcast by Spark while it is small, else a join that splits hot hosts.
    winners = pages.sparkSession.read.parquet(path)
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host")
    ).join(winners, "host", "left")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                extract(html.as_py() or "", paths.as_py() or [], shares.as_py())
                for html, paths, shares in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)
            ]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = rows.select("page_id", "url", "html", "paths", "shares").mapInArrow(extracted, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
