"""Main text of web pages by site template removal.

Every page is parsed into elements, and each block element, inside the article
and outside, is described by a hash of its whole subtree: tags, texts, in
order.  Spark counts on how many pages of a host each hash occurs; subtrees on
many pages of their host are its template and are deleted from every page,
besides elements whose tag, role or class names say that they aren't part of
the text.  What stays is measured, and the text is that of the article or main
element which holds most of it.

Text of an article is protected twice: inside it only subtrees on at least half
of the host's pages go, and none where they hold half of the article or more:
that page is a copy.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import written

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s>]+))?""")

#: HTML's elements without content, with raw content, and those that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag closes these open elements, up to the nearest of the fences.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements that never hold the text of an article.
DROPPED = frozenset("head script style title noscript template nav aside footer form button select option textarea input label iframe object "
                    "svg math canvas audio video dialog menu search noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names in class or id, split at everything but letters and digits.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommended related replies "
    "respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
MAIN = ("article", "main")


class Page:
    """Elements of a page, in order of their start, and its texts with the element that holds each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes, self.end = ["#root"], [-1], [""], [0]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) at its start and end
        self._parse(source)

    def _text(self, node: int, text: str) -> None:
        if text:
            self.events.append((node, text))

    def _close(self, stack: list[int], to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            self.events.append((node, None))
            self.end[node] = len(self.events)

    def _parse(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            self._text(stack[-1], source[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == name:
                        self._close(stack, depth)
                        break
                continue
            if name in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    open_ = self.tag[stack[depth]]
                    if open_ == "p":
                        self._close(stack, depth)
                        break
                    if open_ in BLOCKS:
                        break
            if name in CLOSES:
                ends, fences = CLOSES[name]
                for depth in range(len(stack) - 1, 0, -1):
                    open_ = self.tag[stack[depth]]
                    if open_ in fences:
                        break
                    if open_ in ends:
                        self._close(stack, depth)
                        if name != "tr":
                            break
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attributes.append(m[3] or m[6] or "")
            self.events.append((node, None))
            self.end.append(len(self.events))
            if name in VOID:
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                self._text(node, source[at:close.start() if close else size])
                at = close.end() if close else size
                self.end[node] = len(self.events)
                continue
            stack.append(node)
        self._close(stack, 1)
        self.end[0] = len(self.events)

    def named_away(self) -> list[bool]:
        """Elements whose tag, role or names take them, and all below them, out of the text.

        An element that holds an article or main isn't taken out by its names:
        some sites wrap the whole page in a form.
        """
        holds = [False] * len(self.tag)
        for node in range(len(self.tag) - 1, 0, -1):
            if holds[node] or self._is_main(node):
                holds[self.parent[node]] = True
        away, inside = [False] * len(self.tag), [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            up, tag = self.parent[node], self.tag[node]
            inside[node] = inside[up] or tag in MAIN
            if away[up]:
                away[node] = True
            elif not holds[node] and tag not in ("html", "body", *MAIN):
                away[node] = tag in DROPPED or (tag == "header" and not inside[node]) or self._named(node)
        return away

    def _attribute(self, node: int) -> dict[str, str]:
        return {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(self.attributes[node])} if self.attributes[node].strip(" /") else {}

    def _is_main(self, node: int) -> bool:
        return self.tag[node] in MAIN or ("role" in self.attributes[node] and self._attribute(node).get("role") == "main")

    def _named(self, node: int) -> bool:
        got = self._attribute(node)
        if not got:
            return False
        names = re.split(r"[^a-z0-9]+", got.get("class", "") + " " + got.get("id", ""))
        return (got.get("role") in ROLES or "hidden" in got or bool(NAMES.intersection(names))
                or "display:none" in got.get("style", "").replace(" ", ""))

    def subtree_hashes(self) -> list[int]:
        """A hash per element over its tag, its texts and its elements, in order."""
        out, parts = [0] * len(self.tag), [[] for _ in self.tag]
        for (node, text), at in zip(self.events, range(1, len(self.events) + 1)):
            if text is not None:
                if words := text.split():
                    parts[node].append(" ".join(words))
            elif at == self.end[node] or self.tag[node] in VOID:
                self._seal(node, out, parts)
        for node in range(len(self.tag) - 1, 0, -1):  # raw elements have no end event
            if not out[node]:
                self._seal(node, out, parts)
        return out

    def _seal(self, node: int, out: list[int], parts: list[list[str]]) -> None:
        out[node] = xxhash.xxh64_intdigest("\x1f".join([self.tag[node], *parts[node]])) - (1 << 63)
        parts[node] = []
        if self.parent[node] >= 0:
            parts[self.parent[node]].append(str(out[node]))

    def sizes(self, away: list[bool]) -> list[int]:
        """Letters under each element, without what is away."""
        size = [0] * len(self.tag)
        for node, text in self.events:
            if text is not None and not away[node]:
                size[node] += len(text.strip())
        for node in range(len(self.tag) - 1, 0, -1):
            size[self.parent[node]] += size[node]
        return size

    def main(self, away: list[bool]) -> int | None:
        """The largest article or main element; the outer one of two equal ones."""
        size = self.sizes(away)
        found = [n for n in range(1, len(self.tag)) if not away[n] and self._is_main(n)]
        return max(found, key=lambda n: (size[n], -n)) if found else None

    def candidates(self, away: list[bool], main: int | None) -> list[tuple[int, bool]]:
        """Blocks that template removal may delete, and whether they lie in ``main``: all but article and main elements and what holds the chosen one."""
        holds = {0}
        node = main or 0
        while node > 0:
            holds.add(node)
            node = self.parent[node]
        inside, found = [False] * len(self.tag), []
        for node in range(1, len(self.tag)):
            inside[node] = node == main or inside[self.parent[node]]
            if not away[node] and node not in holds and self.tag[node] in BLOCKS and self.tag[node] not in ("html", "body", *MAIN):
                found.append((node, inside[node]))
        return found

    def without(self, away: list[bool], template: Container[int], common: Container[int]) -> list[bool]:
        """``away`` and the subtrees of the site's template."""
        main, hashes = self.main(away), self.subtree_hashes()
        outer, inner = set(), set()
        for node, inside in self.candidates(away, main):
            if hashes[node] in (common if inside else template):
                (inner if inside else outer).add(node)
        gone = self._below(away, outer | inner)
        if inner and 2 * self.sizes(gone)[main] <= self.sizes(away)[main]:
            return self._below(away, outer)
        return gone

    def _below(self, away: list[bool], roots: set[int]) -> list[bool]:
        gone = list(away)
        for node in range(1, len(self.tag)):
            gone[node] = gone[node] or gone[self.parent[node]] or node in roots
        return gone

    def blocks(self, away: list[bool], below: int) -> str:
        """Texts of the blocks under an element, without what is away."""
        out, now, inside = [], [], [False] * len(self.tag)
        inside[below] = True

        def flush() -> None:
            if text := " ".join(html.unescape("".join(now)).split()):
                out.append(text)
            now.clear()

        for node, text in self.events:
            inside[node] = node == below or (self.parent[node] >= 0 and inside[self.parent[node]])
            if not inside[node] or away[node]:
                if inside[node] and text is None and self.tag[node] in BLOCKS:
                    flush()
            elif text is not None:
                now.append(text)
            elif self.tag[node] in BLOCKS:
                flush()
            elif self.tag[node] == "br":
                now.append(" ")
        flush()
        return "\n\n".join(out)


def main_text(source: str, template: Container[int] = frozenset(), common: Container[int] = frozenset()) -> str:
    """Main text of a page, given the subtree hashes of its site's template and those on at least half of the site's pages.

    Template removal comes first, on every page.  Then the article or main
    element with the most text left is the text, or the whole page where that
    holds less than half of what is left.  Where template removal would leave
    nothing, the page is itself a copy that recurs, and only names decide.
    """
    page = Page(source)
    away = page.named_away()
    for gone in ([page.without(away, template, common)] if template or common else []) + [away]:
        size, main = page.sizes(gone), page.main(gone)
        if text := page.blocks(gone, main if main is not None and 2 * size[main] >= size[0] else 0):
            return text
    return ""


def host_of(url: str | None) -> str | None:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower().removeprefix("www.") if m else None


def site_templates(pages: DataFrame, min_pages: int, min_share: float, inside_share: float = 0.5) -> DataFrame:
    """(host, template, common): the subtree hashes on at least ``min_pages`` pages and ``min_share`` of a host's pages, and
    those of them on ``inside_share`` of its pages; columns host, html.

    A hash on that share of pages takes that share of the blocks of an average
    page, so the list of a host is bounded by blocks per page / ``min_share``.
    Tasks sum per host and hash before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}

        def flush() -> pa.RecordBatch:
            keys, n = list(seen), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(n, pa.int64())], ["host", "hash", "n"])

        for b in batches:
            for host, source in zip(b.column(0).to_pylist(), b.column(1)):
                page = Page(source.as_py() or "")
                hashes = page.subtree_hashes()
                away = page.named_away()
                for h in {hashes[node] for node, _ in page.candidates(away, page.main(away))} | {0}:  # 0 counts the pages
                    seen[host, h] = seen.get((host, h), 0) + 1
                if len(seen) > 100_000:
                    yield flush()
        yield flush()

    counts = pages.where(F.col("host").isNotNull()).mapInArrow(run, "host string, hash long, n long").groupBy("host", "hash").agg(F.sum("n").alias("n"))
    counts = written(counts.where((F.col("hash") == 0) | (F.col("n") >= min_pages)), "subtree-counts")
    sizes = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    many = counts.where("hash <> 0").join(sizes, "host").where(F.col("n") >= min_share * F.col("pages"))
    common = F.collect_list(F.when(F.col("n") >= inside_share * F.col("pages"), F.col("hash")))
    return written(many.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template"), F.sort_array(common).alias("common")), "site-templates")


def extract(pages: DataFrame, min_pages: int = 5, min_share: float = 0.1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``.

    Null or empty html gives an empty text.  A page without a host in its url
    has no site template.  Repeated rows count as pages of their own.  An
    empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host = pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, host], ["page_id", "url", "html", "host"])

    hosted = rows.mapInArrow(hosts, "page_id long, url string, html string, host string")
    templates = site_templates(hosted.select("host", "html"), min_pages, min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = zip(b.column(3).to_pylist(), b.column(4).to_pylist())
            texts = [main_text(s.as_py() or "", frozenset(t or ()), frozenset(c or ())) for s, (t, c) in zip(b.column(2), lists)]
            arrays = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    joined = hosted.join(templates, "host", "left").select("page_id", "url", "html", "template", "common")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
