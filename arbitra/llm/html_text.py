"""Main text of web pages by equivalence classes of tokens over same-host pages.

* A page is a row of tokens: tags with their path, and texts with theirs. Over all
  pages of a host, a token's occurrence vector (how often on each page) is kept as
  the exclusive or of hashes of (page, count), so it is built by partial aggregation
  and no host's pages ever meet in one task. Tokens of one host with equal vectors are
  one equivalence class.
* Classes of ``SIZE`` tokens or more, on at least half of the host's distinct pages
  and at least ``SUPPORT`` of them, make up the host's template, the most common
  outermost. On a page a class counts as valid if its tokens stand as often as
  promised and, once each, in the template's order inside the class around it.
* What stands between template tokens is a slot. The main region is the deepest of
  the template's elements whose slots hold ``MAIN`` of the host's text, and as far up
  as mostly headings come with it. Texts of slots in the region are the result;
  template texts are not, but for headings of an article and where the template
  would take the better part of the article.
* An element's name and classes label the slots in it: menus, headers, footers,
  sidebars, notices, adverts, forms and comments go, wherever they are; what a page
  marks as its article holds the region. Labels alone decide on hosts without a template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix
from .session import materialize, small_batches

SIZE, SUPPORT = 3, 4
#: Share of the host's text that the main region holds at least.
MAIN = 0.8
#: Sums of one worker task that are held before they are handed on.
HELD = 200_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Which open element of the same list a start tag ends.
SIBLINGS = {n: s for s in (frozenset(["li"]), frozenset(["dt", "dd"]), frozenset(["td", "th"]), frozenset(["tr"]), frozenset(["option"])) for n in s}
SCOPES = frozenset("ul ol dl table body html article main section nav aside footer header".split())
AWAY = frozenset("nav header footer aside form menu dialog button head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar ad ads advert adverts advertisement adverttext promo promotion sponsor sponsored banner cookie cookies consent gdpr"
    " notice notices alert comment comments disqus respond form search subscribe subscription newsletter share sharing social related recommended breadcrumb"
    " breadcrumbs pagination pager popup modal toolbar skip masthead copyright widget login signup".split()
)
#: Inside an article, class names count only if they consist of such words and those of layout; paragraphs and headings of one that is an advert's or a notice's.
LAYOUT = frozenset("box wrap wrapper container block area inner outer bar list item items link links left right top bottom section panel row column user users reader readers button buttons".split())
ADVERTS = frozenset("ad ads advert adverts advertisement adverttext promo promotion sponsor sponsored banner cookie cookies consent gdpr newsletter".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPLIT_NAMES = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def _role(name: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """(label of the element in paths, whether what it holds goes)."""
    tag_away = name == "noscript" and not in_article or name in AWAY and not (name == "header" and in_article)
    if not attributes.strip(" /"):
        return name, tag_away
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    label = ".".join([name, *names])
    if name in ("html", "body", "article", "main"):
        return label, False
    telling = WORDS
    if in_article:
        telling = ADVERTS if name == "p" or name in HEADINGS else WORDS - {"header"} if name == "header" else WORDS
    words = ({w.lower() for w in SPLIT_NAMES.split(x) if w} for x in names)
    gone = (
        tag_away
        or any(not w.isdisjoint(telling) and (not in_article or w <= telling | LAYOUT) for w in words)
        or found.get("role", "").lower() in ROLES
        or "hidden" in found
        or found.get("aria-hidden") == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower()
    )
    return label, gone


class Page:
    """A page's tokens in order, and its texts with their place."""

    def __init__(self, html: str) -> None:
        #: (path, text or "" for a tag), and of tags the token of the element around it, or -1
        self.tokens: list[tuple[str, str]] = []
        self.parents: list[int] = []
        #: of each token: characters of the texts that stay in the element, those of headings; whether it is an article
        self.volume: list[list[int]] = []
        #: (block number, raw text, token number or -1, gone, in the article, in a heading, token of the element)
        self.texts: list[tuple[int, str, int, bool, bool, bool, int]] = []
        self.article = False
        self.block = 0
        # open elements: (name, path, gone, in the article, token)
        stack: list[tuple[str, str, bool, bool, int]] = [("", "", False, False, -1)]
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()], stack)
            at = m.end()
            name = (m[3] or "").lower()
            if not name:
                continue
            if name in BLOCKS:
                self.block += 1
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES and name not in SCOPES:
                        break
                continue
            if name == "br":
                self._text(" ", stack)
            if name in BLOCKS and any(x[0] == "p" for x in stack):
                k = max(k for k, x in enumerate(stack) if x[0] == "p")
                if not any(x[0] in SCOPES for x in stack[k:]):
                    del stack[k:]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SIBLINGS.get(name, ()):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
            _, path, gone, inside, around = stack[-1]
            label, away = _role(name, m[4], inside)
            own = (name in ("article", "main") or 'role="main"' in m[4]) and not gone
            inside = inside or own
            self.article = self.article or inside
            token = len(self.tokens)
            self.tokens.append((f"{path}/{label}", ""))
            self.parents.append(around)
            self.volume.append([0, 0, int(own)])
            if name not in VOID and not m[4].endswith("/"):
                stack.append((name, f"{path}/{label}", gone or away, inside, token))
        if at < len(html):
            self._text(html[at:], stack)

    def _text(self, raw: str, stack: list[tuple[str, str, bool, bool, int]]) -> None:
        _, path, gone, inside, around = stack[-1]
        heading = any(x[0] in HEADINGS for x in stack)
        text, token = raw.strip(), -1
        if text:
            if not gone:
                for x in stack[1:]:
                    self.volume[x[4]][0] += len(text)
                    self.volume[x[4]][1] += heading * len(text)
            token = len(self.tokens)
            self.tokens.append((path, text))
            self.parents.append(around)
            self.volume.append([0, 0, 0])
        self.texts.append((self.block, raw, token, gone, inside, heading, around))

    def _within(self, element: int, region: int) -> bool:
        while element >= 0 and element != region:
            element = self.parents[element]
        return element == region

    def main_text(self, template: frozenset[int], region: int | None, ids: np.ndarray) -> str:
        """Blocks of the slots that are kept, in page order."""
        kept = [t for t in self.texts if not t[3] and (t[4] or not self.article)]
        at = np.flatnonzero(ids == region) if region is not None else ()
        if len(at) == 1:
            within = {e: self._within(e, int(at[0])) for e in {t[6] for t in kept}}
            # a page that is laid out in another way has its text elsewhere
            if any(within[t[6]] and t[1].strip() for t in kept):
                kept = [t for t in kept if within[t[6]]]
        fixed = {t[2] for t in kept if t[2] >= 0 and int(ids[t[2]]) in template and not (t[4] and t[5])}
        size = {t[2]: len(t[1].strip()) for t in kept}
        if self.article and 3 * sum(size[t] for t in fixed) > sum(size.values()):
            fixed = set()
        blocks: dict[int, list[str]] = {}
        for block, raw, token, *_ in kept:
            if token < 0 or token not in fixed:
                blocks.setdefault(block, []).append(raw)
        lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
        return "\n".join(x for x in lines if x)


def token_ids(page: Page) -> np.ndarray:
    """A 64-bit hash of each token that is the same in every process."""
    return np.array([xxhash.xxh3_64_intdigest(f"{p}\n{t}") - (1 << 63) for p, t in page.tokens], np.int64)


OCCURRENCES = "host string, token long, parent long, vector long, pages long, times long, first long, depth long, volume long, heads long, article long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token): sums over this task's pages. Token 0 stands for the page itself."""
    sums: dict[tuple[str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = list(zip(*((h, t, *v) for (h, t), v in sums.items()), strict=True))
        names = [c.split()[0] for c in OCCURRENCES.split(", ")]
        return pa.record_batch([pa.array(columns[0], pa.string())] + [pa.array(c, pa.int64()) for c in columns[1:]], names=names)

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page, html_hash = Page(html), xxhash.xxh3_64_intdigest(html)
            ids = token_ids(page).tolist()
            first = dict(zip(reversed(ids), range(len(ids) - 1, -1, -1), strict=True))
            counts = Counter(ids)
            counts[0] = 1
            with np.errstate(over="ignore"):
                parts = mix(mix(np.array([html_hash], U64)) + np.fromiter(counts.values(), U64, len(counts)) * U64(0x9E3779B97F4A7C15)).view(np.int64)
            for (token, times), part in zip(counts.items(), parts.tolist(), strict=True):
                v = sums.get((host, token))
                if v is None:
                    k = first.get(token, -1)
                    around = page.parents[k] if k >= 0 else -1
                    v = sums[host, token] = [ids[around] if around >= 0 else 0, 0, 0, 0, 0, page.tokens[k][0].count("/") if k >= 0 else 0, 0, 0, 0]
                v[1] ^= part
                v[2] += 1
                v[3] += times
                v[4] += first.get(token, 0)
            for token, (volume, heads, article) in zip(ids, page.volume, strict=True):
                v = sums[host, token]
                v[6] += volume
                v[7] += heads
                v[8] = max(v[8], article)
            if len(sums) > HELD:
                yield out()
                sums.clear()
    if sums:
        yield out()


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_region(elements: list) -> int | None:
    """The token of the main region among the elements that stand once on a page: ``token, parent, depth, volume, heads, article``."""
    by_token = {e["token"]: e for e in elements}
    total = max((e["volume"] for e in elements), default=0)
    if not total:
        return None
    region = min((e for e in elements if e["volume"] >= MAIN * total), key=lambda e: (e["volume"], -e["depth"], e["token"]))
    above = by_token.get(region["parent"])
    while above is not None:
        more = above["volume"] - region["volume"]
        if more and 2 * (above["heads"] - region["heads"]) < more:
            break
        if more:
            region = above
        above = by_token.get(above["parent"])
    above = region
    while above is not None:
        if above["article"]:
            region = above
        above = by_token.get(above["parent"])
    return region["token"]


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regions, tokens = [], []
        for template in batch.column(1).to_pylist():
            regions.append(main_region([t for t in template if t["once"]]))
            tokens.append([{"less": t["less"], "class": t["class"], "token": t["token"]} for t in template])
        kind = pa.list_(pa.struct([("less", pa.int64()), ("class", pa.int64()), ("token", pa.int64())]))
        yield pa.record_batch([batch.column(0), pa.array(regions, pa.int64()), pa.array(tokens, kind)], names=["host", "region", "template"])


def host_templates(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``host, region, template``: the token of the host's main region, and the template's tokens with their class, in order.

    Equal pages of one host count once. Classes on under half of the distinct pages,
    or of under ``SIZE`` tokens, and hosts of under ``SUPPORT`` distinct pages give
    nothing: too little to tell a template from a text.
    """
    sums = materialize(
        pages.select(host_of(url).alias("host"), F.coalesce(html, F.lit("")).alias("html")).dropDuplicates(["host", "html"]).mapInArrow(_occurrences, OCCURRENCES),
        "occurrences",
    )
    total = sums.groupBy("host", "token").agg(
        F.bit_xor("vector").alias("vector"), *(F.sum(c).alias(c) for c in ("pages", "times", "first", "volume", "heads")), *(F.max(c).alias(c) for c in ("parent", "depth", "article"))
    )
    hosts = total.filter("token = 0").select("host", F.col("pages").alias("of"))
    common = total.filter("token <> 0").join(hosts, "host").filter(f"2 * pages >= of and of >= {SUPPORT}")
    classes = common.groupBy("host", "vector", "pages", "times").agg(F.count("*").alias("size")).filter(f"size >= {SIZE}")
    member = F.struct((-F.col("pages")).alias("less"), F.col("vector").alias("class"), (F.col("first") / F.col("pages")).alias("at"), "token", "parent", "depth", "volume", "heads", "article", F.expr("times = pages").alias("once"))
    templates = common.join(classes, ["host", "vector", "pages", "times"]).groupBy("host").agg(F.array_sort(F.collect_list(member)).alias("template"))
    return templates.mapInArrow(_templates, "host string, region long, template array<struct<less: long, class: long, token: long>>")


def valid_tokens(ids: np.ndarray, template: list) -> frozenset[int]:
    """Template tokens of the classes that are valid on a page.

    Classes come from the most common on, each inside the span of the last valid
    one around it. A class whose tokens all stand once must have them in the
    template's order.
    """
    where: dict[int, list[int]] = {}
    for k, t in enumerate(ids.tolist()):
        where.setdefault(t, []).append(k)
    good: set[int] = set()
    outer: tuple[int, int] | None = None
    by_class: dict[tuple[int, int], list[int]] = {}
    for x in template:
        by_class.setdefault((x["less"], x["class"]), []).append(x["token"])
    for tokens in by_class.values():
        counts = {len(where.get(t, ())) for t in tokens}
        if len(counts) != 1 or 0 in counts:
            continue
        places = [where[t][0] for t in tokens]
        inside = outer is None or (outer[0] <= min(places) and max(where[t][-1] for t in tokens) <= outer[1])
        if not inside or (counts == {1} and places != sorted(places)):
            continue
        good.update(tokens)
        if outer is None and counts == {1}:
            outer = (min(places), len(ids))
    return frozenset(good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, region, template in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            page = Page(html or "")
            ids = token_ids(page)
            texts.append(page.main_text(valid_tokens(ids, template or []), region, ids))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``, over the whole html.

    Blocks are joined by line ends; white space inside a block is one blank; character
    references are decoded once. A null or empty page, and one without main text,
    give an empty text. A page whose host has no template (few pages, null url) is cut
    by the roles of its elements alone. Repeated rows give repeated results.
    """
    small_batches(pages.sparkSession, 500)
    templates = materialize(host_templates(pages, html, url), "templates")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    return (
        rows.join(templates, "host", "left")
        .select("page_id", "url", "html", "region", "template")
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
    )
