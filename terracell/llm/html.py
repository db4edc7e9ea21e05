"""HTML main-text extraction with consensus host paths (operator 2).

A page is read once into its kept text blocks and its containers, each of which covers a run of
blocks.  Containers are scored; each page votes for the generalised tag-class path of its best
one; votes are summed per host in Spark, combined before the shuffle; and every page is then
extracted again from the containers on its host's winning path, or from its own best container
where the page has none there.  Winning paths (one row a host) are broadcast only while their
measured size is under ``BROADCAST_BYTES``; beyond it, pages are joined on (host, salt).

A form is dropped unless the page's text stands in it: unless it holds an article, main or h1 element or
over half of the text; its controls always go.  A class drops its element by whole words of a
name such as ``site-footer``, but not where the name denies it, as ``no-sidebar`` does.  Reading a page takes
time and memory linear in its size, however deep it is and whatever is left open.

Defined results: null and empty pages have the text ''; a null url is the host ''; ties between paths
go to the one that sorts first; repeated rows give repeated results; empty tables give no rows; other
columns are ignored; a page must fit in a task's memory.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

BROADCAST_BYTES = 32 << 20
SALTS = 64

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)", re.S)
_CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "select", "object", "canvas", "audio", "video", "xmp")}
_VOID = frozenset("br img hr input meta link area base col embed source track wbr param".split())
_DROP = frozenset("head nav header footer aside button fieldset dialog menu label legend".split())
_BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address details summary center hgroup form".split()) | _DROP
_CONTAINER = frozenset("body main article section div td".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside"
    " comment comments commentlist discussion disqus replies reply respond notice notices notification alert cookie cookies consent gdpr popup modal overlay newsletter subscribe"
    " subscription signup share sharing social related recommended footer header masthead pagination pager toolbar widget widgets skip".split()
)
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_DENIED = frozenset("no not non without with has hide hides".split())
_GOOD = frozenset("article content post story entry main text body".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NUMBER = re.compile(r"\d+")


def _is_bad(names: dict[str, str]) -> bool:
    """Whether a class or id, by whole words, is of what stands beside an article."""
    for name in f"{names.get('class', '')} {names.get('id', '')}".split():
        words = _WORDS.findall(_CAMEL.sub("-", name).lower())
        if not _BAD.isdisjoint(words) and _DENIED.isdisjoint(words):
            return True
    return False


class Page:
    """Kept blocks [(text, characters in links)] and containers [(path's number, tag, first block, end block, hinted)].

    ``paths`` numbers paths by their parent's number and their last segment; the empty path is 0.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int]] = []
        self.containers: list[tuple[int, str, int, int, bool]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self._text: list[str] = []
        self._linked = 0
        self._forms: list[list[int]] = []  # [first block, end block, whether it holds an article]
        self._open: Counter[str] = Counter()
        stack: list[list] = []  # [tag, path, dropped, container's place or None]
        at, links, dropped = 0, 0, False
        n = len(source)
        last = source.rfind(">") + 1  # no tag ends after it
        while at < n:
            m = _TOKEN.search(source, at, last) if at < last else None
            if m is None:
                rest = source[at:]
                cut = min((i for i in (rest.find("<!--"), rest.find("<![CDATA[")) if i >= 0), default=len(rest))
                self._add(rest[:cut], dropped, links)
                break
            if m.start() > at:
                self._add(source[at : m.start()], dropped, links)
            at = m.end()
            tag = m.group(2)
            if tag is None:
                if source.startswith("<!--", m.start()) and not m.group().endswith("-->") or source.startswith("<![CDATA[", m.start()) and not m.group().endswith("]]>"):
                    at = n  # left open: to the end
                if source.startswith("<![CDATA[", m.start()):
                    self._text.append("" if dropped else source[m.start() + 9 : at].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = tag.lower()
            if m.group(1):
                if self._open[tag]:
                    at_tag = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                    dropped, links = self._close(stack, at_tag, links)
                elif tag in _BLOCK:
                    self._flush()
                continue
            if tag in _RAW and not m.group(3).endswith("/>"):
                end = _RAW[tag].search(source, at)
                at = end.end() if end else n
                continue
            if tag == "br":
                self._text.append(" ")
                continue
            if tag in _VOID:
                if tag == "hr":
                    self._flush()
                continue
            if tag in _BLOCK:
                self._flush()
                shut = {"p"} | _CLOSED_BY.get(tag, set())
                for i in range(len(stack) - 1, -1, -1) if any(self._open[t] for t in shut) else ():
                    if stack[i][0] in shut:
                        dropped, links = self._close(stack, i, links)
                        break
                    if stack[i][0] in _CONTAINER or stack[i][0] in ("ul", "ol", "table", "dl"):
                        break
            names = {k.lower(): a or b or c for k, a, b, c in _CLASS.findall(m.group(3))}
            bad = tag in _DROP or (tag not in ("body", "html", "main", "article") and _is_bad(names)) or (names.get("role", "").lower() in _BAD_ROLES and tag != "form")
            path = stack[-1][1] if stack else 0
            if tag in _CONTAINER:
                classes = ".".join(sorted({_NUMBER.sub("#", c) for c in names.get("class", "").lower().split()}))
                path = self.paths.setdefault((path, tag + ("." + classes if classes else "")), len(self.paths) + 1)
            dropped = dropped or bad
            place = None
            if tag in _CONTAINER and not dropped:
                place = len(self.containers)
                hinted = not _GOOD.isdisjoint(_WORDS.findall(f"{names.get('class', '')} {names.get('id', '')}".lower()))
                self.containers.append((path, tag, len(self.blocks), -1, hinted))
            if tag == "form" and not dropped and not self._open["form"]:  # forms don't nest
                self._forms.append([len(self.blocks), -1, False])
            elif tag in ("article", "main", "h1") and not dropped and self._open["form"] and self._forms:
                self._forms[-1][2] = True
            stack.append([tag, path, dropped, place])
            self._open[tag] += 1
            links += tag == "a"
        self._close(stack, 0, links)
        self._flush()
        self._drop_forms()

    def _drop_forms(self) -> None:
        """Leaves out the blocks of forms that don't hold the page's text."""
        total = sum(len(t) for t, _ in self.blocks)
        gone = [(a, b) for a, b, holds in self._forms if b > a and not holds and 2 * sum(len(t) for t, _ in self.blocks[a:b]) <= total]
        if gone:
            keep = [True] * len(self.blocks)
            for a, b in gone:
                keep[a:b] = [False] * (b - a)
            place = [0, *accumulate(keep)]
            self.blocks = [x for x, k in zip(self.blocks, keep, strict=True) if k]
            self.containers = [(p, t, place[a], place[b], h) for p, t, a, b, h in self.containers]

    def path(self, number: int) -> str:
        """A path as text, its segments apart by spaces."""
        parents = {own: key for key, own in self.paths.items()}
        segments = []
        while number:
            number, segment = parents[number]
            segments.append(segment)
        return " ".join(reversed(segments))

    def _add(self, text: str, dropped: bool, links: int) -> None:
        if not dropped:
            self._text.append(text)
            if links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(_html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _close(self, stack: list[list], down_to: int, links: int) -> tuple[bool, int]:
        for tag, _, _, place in reversed(stack[down_to:]):
            if tag in _BLOCK:
                self._flush()
            if place is not None:
                path, name, first, _, hinted = self.containers[place]
                self.containers[place] = (path, name, first, len(self.blocks), hinted)
            links -= tag == "a"
            self._open[tag] -= 1
            if tag == "form" and not self._open["form"] and self._forms and self._forms[-1][1] < 0:
                self._forms[-1][1] = len(self.blocks)
        del stack[down_to:]
        return (bool(stack) and stack[-1][2]), links

    def best(self) -> tuple[int, str, int, int, bool] | None:
        """The container of the main text: the outermost article or main with a fair share of the
        text, or else the deepest container that holds most of it, hints in names preferred, widened
        while what that adds is text rather than links."""
        before, all_before = [0], [0]
        for t, linked in self.blocks:
            before.append(before[-1] + len(t) - linked)
            all_before.append(all_before[-1] + len(t))
        scored = [(before[c[3]] - before[c[2]], c) for c in self.containers if c[3] > c[2]]
        most = max((s for s, _ in scored), default=0)
        if most <= 0:
            return None
        for kind in ("article", "main"):
            for s, c in scored:
                if c[1] == kind and s >= 0.25 * most:
                    return c
        hinted = [c for s, c in scored if c[4] and s >= 0.6 * most]
        if hinted:
            return hinted[0]
        around = [c for s, c in scored if s >= 0.7 * most]
        found = around[-1]
        for c in reversed(around[:-1]):
            if c[2] <= found[2] and found[3] <= c[3]:
                own, whole = (x[found[2]] - x[c[2]] + x[c[3]] - x[found[3]] for x in (before, all_before))
                if own < 0.9 * whole:
                    break
                found = c
        return found

    def text(self, path: str | None = None) -> str:
        """The blocks of the containers on ``path``, or of the page's best one, or of the page."""
        number: int | None = 0
        for segment in path.split(" ") if path else ():
            number = self.paths.get((number, segment))
            if number is None:
                break
        found = [c for c in self.containers if c[0] == number and c[3] > c[2]] if path and number else []
        if not found and (b := self.best()):
            found = [b]
        if not found:
            return "\n".join(t for t, _ in self.blocks)
        out, end = [], 0
        for _, _, a, b, _ in found:  # in page order; nested ones repeat nothing
            out += [t for t, _ in self.blocks[max(a, end) : b]]
            end = max(end, b)
        return "\n".join(out)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [Page(h) for h in common.texts(batch, "html")]
        best = [p.path(b[0]) if (b := p.best()) else None for p in pages]
        yield pa.record_batch([batch.column("host"), pa.array(best, pa.string())], names=["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(h).text(p) for h, p in zip(common.texts(batch, "html"), batch.column("path").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and the path that most of its pages vote for."""
    votes = common.arrow_map(pages.select("host", "html"), _votes, "host string, path string").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    winners = common.cut(winning_paths(own))
    size = winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = own.join(F.broadcast(winners), "host", "left")
    else:
        salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    return common.arrow_map(joined.select("page_id", "url", "html", "path"), _extract, "page_id long, url string, text string, n_chars long")
