"""Main text of web pages by consensus host paths.

Every page is read into its blocks of text and the containers around them. A first pass scores each page's containers
by the text in them that is not link text (full for the nearest container, a half and a third for the next two; more for
article, main and containers named as content) and lets the page vote for the path of its best one. A path is the tags
with their classes from the body down, with runs of digits generalised and ids read only where there are no classes.
Votes are counted in Spark by (host, path); the paths with a tenth of a host's votes or more (ten at most) win. The second
pass reads each page again and takes the blocks inside the elements on the first winning path that gives text there, or
else inside its own best container.

Left out everywhere: scripts, styles, templates, navigation, page headers, footers, asides, forms and their controls,
hidden elements, and elements whose class, id or role names a menu, sidebar, notice, advert, share bar, form or reader
comments. A header inside an article keeps its headings. Character references are decoded, white space inside a block
becomes one space, blocks are joined by an empty line; a line break is white space.

Defined cases: a null or empty html, or one without main text, gives an empty text; pages without a host (null url, no
``://``) use their own best container; null and repeated ids are rows like any other; unclosed and stray tags are
repaired, an unclosed comment, tag or script reaches to the end; a page of any length or depth is read whole in one pass.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from annoscope.llm import _text as tx
from annoscope.session import written

SHARE = 10  # a path needs one in so many of its host's votes

# HTML's element kinds.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, roles and names that are not main text.
SKIPPED = frozenset("nav footer aside form button select datalist noscript template svg math canvas audio video object dialog menu search label legend".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle banner banners sponsor sponsored promo promotion nav navbar navigation menu menus "
                  "breadcrumb breadcrumbs masthead topbar footer sidebar sidebars aside widget widgets related recommended recommendations trending teaser cookie "
                  "cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup paywall share sharing social "
                  "comment comments disqus reply replies respond form search login pagination pager toolbar".split())
IN_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply related teaser".split())
CONTENT = frozenset("article articlebody content post entry story text main body".split())
NEGATED = frozenset("no not has with without open closed enabled disabled hide".split())
CONTAINERS = frozenset("body article main section div td".split())
FACTOR = {"article": 2.5, "main": 1.2}
_NEUTRAL = frozenset("html body".split())

_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=|[^>=]++)*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>]+))|([^\s=/]+)""")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[A-Za-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault((m[1] or m[5]).lower(), html.unescape(m[2] or m[3] or m[4] or "").lower())
    return out


def _named(names: list[str], words: frozenset[str]) -> bool:
    """Whether a class or id is one of ``words`` or begins or ends with one ("ad-box", not "no-sidebar")."""
    for name in names:
        parts = _WORD.findall(name)
        if parts and (parts[0] in words or parts[-1] in words) and not NEGATED.intersection(parts):
            return True
    return False


class Page:
    """The blocks of one page: ``blocks`` has (element, text, link characters), ``parent``, ``tag``, ``step``, ``key``
    describe the elements by number; element 0 is the body, and a parent's number is smaller."""

    def __init__(self, text: str):
        self.parent, self.tag, self.step, self.key, self.factor = [0], ["body"], [""], [0], [1.0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(text)

    def _element(self, parent: int, tag: str, attrs: dict[str, str]) -> int:
        if tag in _NEUTRAL:
            return parent
        names = attrs.get("class", "").split()
        step = tag + "".join(f".{c}" for c in sorted({_DIGITS.sub("0", c) for c in names}))
        if not names and attrs.get("id"):
            step += "#" + _DIGITS.sub("0", attrs["id"])
        self.parent.append(parent)
        self.tag.append(tag)
        self.step.append(step)
        self.key.append(xxhash.xxh64_intdigest(step, self.key[parent]))
        f = FACTOR.get(tag, 1.0)
        if tag in CONTAINERS and _named([*names, attrs.get("id", ""), attrs.get("itemprop", "")], CONTENT):
            f = max(f, 1.5)
        self.factor.append(f)
        return len(self.parent) - 1

    @staticmethod
    def _skips(tag: str, attrs: dict[str, str], article: bool) -> bool:
        if tag in _NEUTRAL:
            return False
        names = [*attrs.get("class", "").split(), attrs.get("id", "")]
        if tag in ("article", "main"):
            return _named(names, IN_ARTICLES)
        return (tag in SKIPPED or (tag == "header" and not article) or "hidden" in attrs or attrs.get("role") in ROLES
                or attrs.get("aria-hidden") == "true" or (bool(attrs) and (_named(names, NAMES) or (not article and _named(names, frozenset(["header"]))))))

    def _read(self, text: str) -> None:
        # open elements: (tag, element, skipped, form, article, header, link, place of the open p, of the open li, of the open row or cell, of the last block)
        base = ("body", 0, False, False, False, False, False, -1, -1, -1, 0)
        stack, opened = [base], Counter()
        words: list[str] = []
        links = at = 0
        n = len(text)

        def flush() -> None:
            nonlocal links
            if words:
                block = " ".join("".join(words).split())
                if block:
                    self.blocks.append((stack[stack[-1][10]][1], block, links))
                words.clear()
            links = 0

        def cut(depth: int) -> None:
            """Close all from the open element at ``depth`` on."""
            if stack[-1][10] >= depth:
                flush()
            for e in stack[depth:]:
                opened[e[0]] -= 1
            del stack[depth:]

        while at < n:
            m = _MARK.search(text, at)
            piece = text[at:m.start()] if m else text[at:]
            top = stack[-1]
            if piece and not (top[2] or top[3] or (top[5] and not self._in_heading(stack))):
                piece = html.unescape(piece)
                words.append(piece)
                if top[6]:
                    links += len(piece)
            if not m:
                break
            at = m.end()
            if m["tag"] is None:
                continue
            tag = m["tag"].lower()
            if m["end"]:
                if tag == "br":
                    words.append(" ")
                elif opened[tag] > 0:
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    if tag in BLOCKS or top[10] < depth:  # an inline end tag closes nothing across a block
                        cut(depth)
                continue
            if tag == "br":
                words.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(text, at)
                at = end.end() if end else n
                continue
            block = tag in BLOCKS
            if block:
                flush()
                if stack[-1][7] >= 0:
                    cut(stack[-1][7])
                if tag in ("li", "dt", "dd") and stack[-1][8] >= 0:
                    cut(stack[-1][8])
                elif tag in ("td", "th", "tr"):
                    while stack[-1][9] >= 0 and (tag == "tr" or stack[stack[-1][9]][0] != "tr"):
                        cut(stack[-1][9])
            if m["attrs"].endswith("/") and tag not in BLOCKS:  # <span/>, <path/>: treated as empty
                continue
            top, depth = stack[-1], len(stack)
            attrs = _attributes(m["attrs"])
            article = top[4] or tag in ("article", "main")
            skipped, form, header = top[2], top[3], top[5]
            if tag == "form":
                form = True
            elif tag in ("article", "main"):
                form = False
                skipped = skipped or self._skips(tag, attrs, article)
            elif tag == "header" and article:
                header = True
                skipped = skipped or "hidden" in attrs
            else:
                skipped = skipped or self._skips(tag, attrs, article)
            scope, lists = tag in ("table", "td", "th", "caption", "object", "button"), tag in ("ul", "ol", "dl", "table")
            p = depth if tag == "p" else -1 if scope else top[7]
            li = depth if tag in ("li", "dt", "dd") else -1 if lists else top[8]
            cell = depth if tag in ("tr", "td", "th") else -1 if tag == "table" else top[9]
            number = self._element(top[1], tag, attrs) if block else top[1]
            stack.append((tag, number, skipped, form, article, header, top[6] or tag == "a", p, li, cell, depth if block else top[10]))
            opened[tag] += 1
        flush()

    @staticmethod
    def _in_heading(stack: list[tuple]) -> bool:
        return stack[stack[-1][10]][0] in HEADINGS

    def best(self) -> tuple[int, int]:
        """(element, score) of the page's best container; (0, 0) without text."""
        score: dict[int, float] = {}
        for element, text, links in self.blocks:
            worth = len(text) - 2 * links
            if worth <= 0:
                continue
            for level in (1, 2, 3):
                while element and self.tag[element] not in CONTAINERS:
                    element = self.parent[element]
                score[element] = score.get(element, 0.0) + worth * self.factor[element] / level
                if not element:
                    break
                element = self.parent[element]
        if not score:
            return 0, 0
        element = min(score, key=lambda e: (-score[e], e))
        return element, int(score[element])

    def path(self, element: int) -> str:
        steps = []
        while element:
            steps.append(self.step[element])
            element = self.parent[element]
        return "/".join(reversed(steps))

    def _inside(self, roots: set[int]) -> str:
        inside = [e in roots for e in range(len(self.parent))]
        for e in range(1, len(inside)):
            inside[e] = inside[e] or inside[self.parent[e]]
        return "\n\n".join(text for element, text, _ in self.blocks if inside[element])

    def main_text(self, winners: list[int]) -> str:
        """The text on the first of the paths (by key) that holds any, else in the page's best container."""
        by_key: dict[int, set[int]] = {k: set() for k in winners}
        for e, k in enumerate(self.key):
            if k in by_key:
                by_key[k].add(e)
        for k in winners:
            if by_key[k] and (text := self._inside(by_key[k])):
                return text
        return self._inside({self.best()[0]})


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "html"):
            hosts, keys, paths, scores = [], [], [], []
            for host, text in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                page = Page(text or "")
                element, score = page.best()
                if score:
                    hosts.append(host)
                    keys.append(_signed(page.key[element]))
                    paths.append(page.path(element))
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())],
                                             ["host", "key", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "html"):
            texts = [Page(text).main_text([k % (1 << 64) for k in keys or ()]) if text else "" for text, keys in
                     zip(part.column("html").to_pylist(), part.column("winners").to_pylist())]
            rest = part.select(["id", "url"]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string())], ["id", "url", "text"])


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", html_col: str = "html") -> DataFrame:
    """(host, rank, path, key, votes, score): the winning paths of each host, most votes first."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html_col).alias("html")).where("host != '' AND html IS NOT NULL")
    votes = rows.mapInArrow(_vote, "host string, key long, path string, score long")
    votes = written(votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score")), "path-votes")
    total = votes.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    kept = votes.join(total, "host").where(F.col("votes") * SHARE >= F.col("all_votes"))
    order = F.sort_array(F.collect_list(F.struct(-F.col("votes"), -F.col("score"), "key", "path", "votes", "score")))
    return kept.groupBy("host").agg(order.alias("best")).select("host", F.posexplode("best").alias("rank", "b")).select(
        "host", (F.col("rank") + 1).alias("rank"), "b.path", "b.key", "b.votes", "b.score")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    paths = host_paths(pages, url, html_col).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("ranked"))
    winners = written(paths.select("host", F.col("ranked.key").alias("winners")), "host-paths")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url)).alias("host"))
    both = rows.join(winners, "host", "left").select("id", "url", "html", "winners")
    types = {c: rows.schema[c].dataType.simpleString() for c in ("id", "url")}
    out = both.mapInArrow(_extract, f"id {types['id']}, url {types['url']}, text string")
    return out.select(F.col("id").alias(page_id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
