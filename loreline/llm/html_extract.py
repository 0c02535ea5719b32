"""Main text of web pages: block structure of the whole page, then nearest-URL page differencing.

A page is scanned once into text blocks. Blocks inside page furniture (by element, role, class or id) are dropped, and where the page
marks its article, the blocks outside it too. A block element that holds nine tenths of the text is no furniture for its class alone. What is left is compared with the pages nearest by URL path on the same host: lines are
aligned by longest common subsequence and shared lines deleted, but for a page that shares all its lines (a copy).

Two articles of a host may share a headline or a paragraph, which are main text of both (README has figures), so inside a marked article
two neighbours are not enough: it is compared with the ``NEAR`` nearest pages on either side (of the host's marked pages, ``NEAR`` in all
at least), and a line goes if it is shared with every one of them. ``difference_marked`` compares it with one on either side, as
unmarked pages are. Two marked pages that share at least ``ALIKE`` of the shorter one's characters count as copies of one article, and
take nothing from each other. Of marked pages only line hashes travel; their texts do only where very many lose lines.

Pages are ranked within ranges of sorted (host, path, page id); the first and last pages of a range are lent to the ranges beside it, so
a host of any size spreads over many tasks and every page still meets its true neighbours. A neighbour travels as one hash and one
length a line. The alignment takes memory of the lines, not of their product.

Defined cases: null or empty html gives empty text; null url pairs with other null urls; repeated pages and ties are ordered by page
id; other columns are ignored, whatever their names; broken markup is read as far as it goes, in one pass; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import re
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm._frames import checkpoint, col, shuffle_partitions

# Elements of HTML by role.
DROPPED = frozenset("head title script style template noscript svg iframe object canvas select option textarea button form nav footer aside menu dialog audio video datalist".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_ROLES = frozenset("main article".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related share sharing social cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login form search comment comments reply replies respond disqus discussion pagination pager toolbar copyright legal disclaimer".split())

ABOUT = frozenset("has no with without is not hide show".split())  # first words of class names that tell of a page, not of an element

_TOKEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_EDGE = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")
_CLASS_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ALIKE = 0.5  # share of the characters from which two marked articles are copies
WHOLE = 0.9  # share of the text from which a block element is the page itself, whatever its class or id says
NEAR = 8  # pages on either side that a line of a marked article must be shared with
MOST_RANGES, SAMPLED = 4096, 16  # ranges of pages, and keys looked at for each; both affect cost alone, as long as a range gets NEAR pages
FEW = 20_000  # pages that lose lines of their article, up to which these are broadcast


def _furniture(tag: str, attrs: str, in_article: bool) -> str:
    """"yes" for an element that is page furniture by its kind, role or state, "told" for one that only its class or id calls so, else ""."""
    if tag in DROPPED or tag == "header" and not in_article:
        return "yes"
    if not attrs.strip():
        return ""
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if "hidden" in _ATTR.sub(" ", attrs).lower().split() or found.get("aria-hidden", "").lower() == "true":
        return "yes"
    if tag in ("html", "body", "article", "main"):
        return ""
    if found.get("role", "").lower() in FURNITURE_ROLES:
        return "yes"
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in _CLASS_WORD.findall(_CAMEL.sub(" ", name))]
        if words and words[0] not in ABOUT and not FURNITURE_WORDS.isdisjoint(words):
            return "told"
    return ""


def _tag_end(html: str, at: int, missing: set[str]) -> int:
    """Where the tag ends (after its >); a quote that is never closed is a character like others. ``missing`` keeps what no longer comes."""
    while True:
        m = _EDGE.search(html, at)
        if not m:
            return len(html)
        at = m.end()
        mark = m[0]
        if mark == ">":
            return at
        if mark not in missing:
            close = html.find(mark, at)
            if close < 0:
                missing.add(mark)
            else:
                at = close + 1


def _after(html: str, mark: str, at: int) -> int:
    found = html.find(mark, at)
    return len(html) if found < 0 else found + len(mark)


def page_blocks(html: str | None) -> tuple[list[str], bool]:
    """Text blocks of a page in page order, without furniture; only those of its article if it marks one that has text (and whether it does).

    Several articles with less text than stands beside them are teasers: they mark nothing, and go.
    """
    if not html:
        return [], False
    blocks: list[tuple[str, int, tuple[int, ...]]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []  # element, furniture, number of its article, of block elements that are so by name; each with what stands around it
    bad, article, told, count = False, 0, (), 0

    def flush():
        nonlocal text
        if text:
            joined = _SPACE.sub(" ", unescape("".join(text))).strip()
            if joined:
                blocks.append((joined, article, told))
            text = []

    at, n, missing = 0, len(html), set()
    while at < n:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else n
        if stop > at and not bad:
            text.append(html[at:stop])
        if not m:
            break
        if m[1] or m[2] or m[3]:
            at = _after(html, "-->" if m[1] else "]]>" if m[2] else ">", m.end())
            continue
        at = _tag_end(html, m.end(), missing)
        tag, attrs = m[5].lower(), html[m.end():at].rstrip(">")
        if tag == "br":
            text.append(" ")
        if tag in BLOCK:
            flush()
        if m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCK and any(x[0] in BLOCK for x in stack[k + 1:]):
                        break  # a stray end of an inline element does not close blocks
                    del stack[k:]
                    bad, article, told = stack[-1][1:] if stack else (False, 0, ())
                    break
            continue
        if tag in RAW and tag != "noscript":
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag == "p" or tag in BLOCK and stack and stack[-1][0] == "p":
            while stack and stack[-1][0] == "p":
                stack.pop()
            bad, article, told = stack[-1][1:] if stack else (False, 0, ())
        is_article = tag in ARTICLE_ROLES or re.search(r"role\s*=\s*[\"']?(main|article)\b", attrs, re.I) is not None
        kind = _furniture(tag, attrs, article > 0)
        count += 1
        if kind == "told" and tag in BLOCK:
            told = (*told, count)
        else:
            bad = bad or kind != ""
        if is_article and not bad and not article:
            article = count
        stack.append((tag, bad, article, told))
    flush()
    size: dict[int, int] = {}
    for b, _, around in blocks:
        for k in around:
            size[k] = size.get(k, 0) + len(b)
    whole = sum(len(b) for b, *_ in blocks)
    kept = [(b, a) for b, a, around in blocks if all(size[k] >= WHOLE * whole for k in around)]
    inside = sum(len(b) for b, a in kept if a)
    teasers = len({a for _, a in kept if a}) > 1 and 2 * inside < sum(len(b) for b, _ in kept)
    if inside and not teasers:
        return [b for b, a in kept if a], True
    return [b for b, a in kept if not a], False


def blocks_of(html: str | None) -> list[str]:
    return page_blocks(html)[0]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.where(b == x, row[:-1] + 1, row[1:]))
    return row


def _align(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> None:
    """Mark in ``mask`` the lines of ``a`` on a longest common subsequence with ``b`` (Hirschberg's division)."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        if hi - lo == 1:
            mask[lo] = bool((b[left:right] == a[lo]).any())
        elif hi > lo and right > left:
            mid = (lo + hi) // 2
            cut = int(np.argmax(_lengths(a[lo:mid], b[left:right]) + _lengths(a[mid:hi][::-1], b[left:right][::-1])[::-1]))
            todo += [(lo, mid, left, left + cut), (mid, hi, left + cut, right)]


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Mask of ``own`` lines on a longest common subsequence with ``other`` (line hashes; common ends first)."""
    mask = np.zeros(len(own), bool)
    lo, hi_a, hi_b = 0, len(own), len(other)
    while lo < min(hi_a, hi_b) and own[lo] == other[lo]:
        mask[lo] = True
        lo += 1
    while hi_a > lo and hi_b > lo and own[hi_a - 1] == other[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
        mask[hi_a] = True
    a, b = own[lo:hi_a], other[lo:hi_b]
    where = np.flatnonzero(np.isin(a, b))  # lines the other page lacks cannot be on it
    a, b = a[where], b[np.isin(b, a)]
    inner = np.zeros(len(a), bool)
    _align(a, b, inner)
    mask[lo + where[inner]] = True
    return mask


def _parse(batches):
    for pdf in batches:
        found = [page_blocks(h) for h in pdf["html"]]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "blocks": [b for b, _ in found], "marked": [m for _, m in found]})


def kept_blocks(own: list[str], lines: np.ndarray, marked: bool, others: list[dict | None]) -> list[str]:
    """The blocks of a page that it shares with none of its neighbours (lines, sizes, marked)."""
    size = np.array([len(x) for x in own], np.int64)
    gone = np.zeros(len(own), bool)
    for other in others:
        if other is not None and len(other["lines"]) and len(own):
            mask = shared_lines(lines, np.asarray(other["lines"], np.int64))
            if not (marked and other["marked"] and size[mask].sum() >= ALIKE * min(size.sum(), sum(other["sizes"]))):
                gone |= mask
    return own if gone.all() else [x for x, g in zip(own, gone) if not g]  # a page that shares every line is a copy, not furniture


@F.pandas_udf(T.StringType())
def _difference(blocks: pd.Series, lines: pd.Series, marked: pd.Series, before: pd.DataFrame, after: pd.DataFrame) -> pd.Series:
    beside = [x.to_dict("records") for x in (before, after)]
    out = []
    for i, (own, h, m) in enumerate(zip(blocks, lines, marked)):
        own = list(own) if own is not None else []
        others = [b[i] if b[i]["lines"] is not None else None for b in beside]
        out.append("\n".join(kept_blocks(own, np.asarray(h, np.int64), bool(m), others)) if own else "")
    return pd.Series(out, dtype=object)


ORDER = ("host", "path", "key", "tie")


def _splits(keyed: DataFrame) -> list[tuple]:
    """Keys at which ranges of pages begin: keys of the table, so that no range but the first is empty."""
    ranges = min(MOST_RANGES, 2 * shuffle_partitions(keyed.sparkSession))
    keys = keyed.select("host", "path", "key").orderBy(F.xxhash64("host", "path", "key")).limit(ranges * SAMPLED).collect()
    return sorted({tuple(k) for k in sorted(tuple(k) for k in keys)[::SAMPLED]})


def _in_ranges(keyed: DataFrame, most: int = 1) -> DataFrame:
    """Pages with the range of their key; the ``most`` first and last pages of each range stand in the ranges beside it too, as ``lent``."""
    splits = keyed.sparkSession.sparkContext.broadcast(_splits(keyed))

    @F.pandas_udf(T.LongType())
    def which(host: pd.Series, path: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(splits.value, k) for k in zip(host, path, key)], dtype="int64")

    ranged = keyed.withColumn("range", which("host", "path", "key"))
    within = Window.partitionBy("range").orderBy(*ORDER)
    here = lambda at: at(F.lit(1), most).over(within).isNull()
    ends = ranged.select("range", *ORDER, "lines", "sizes", "marked").withColumns({"first": here(F.lag), "last": here(F.lead)})
    lent = ends.filter("last").withColumn("range", F.col("range") + 1).unionByName(ends.filter("first").withColumn("range", F.col("range") - 1)).drop("first", "last")
    return ranged.withColumn("lent", F.lit(False)).unionByName(lent.withColumn("lent", F.lit(True)), allowMissingColumns=True)


def _keyed(parsed: DataFrame) -> DataFrame:
    """Pages with what they are ordered by (nearest by URL path within the host: neighbours in the order of host, path and page id) and line hashes."""
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    return parsed.withColumns({
        "host": F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1),
        "path": F.regexp_replace(F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""),
        "key": F.coalesce("page_id", F.lit(-(2**63))),
        "lines": F.transform("blocks", lambda b: F.xxhash64(b)),
        "sizes": F.transform("blocks", lambda b: F.length(b))}).withColumn("tie", F.xxhash64("lines", "url"))


def template_lines(lines: np.ndarray, sizes: np.ndarray, others: list[dict]) -> np.ndarray:
    """Mask of the lines of a marked article that it shares with all ``others`` (lines, total size); none if one of them is a copy of it."""
    gone = np.ones(len(lines), bool)
    for other in others:
        mask = shared_lines(lines, np.asarray(other["lines"], np.int64))
        gone &= mask
        if not gone.any() or sizes[mask].sum() >= ALIKE * min(sizes.sum(), other["total"]):
            return np.zeros(len(lines), bool)
    return gone


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _template(lines: pd.Series, sizes: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([template_lines(np.asarray(a, np.int64), np.asarray(b, np.int64), list(o)) for a, b, o in zip(lines, sizes, others)], dtype=object)


def _marked_text(parsed: DataFrame) -> DataFrame:
    """Text of pages that mark an article: page_id, url, text, marked, n_lines. What is shared with all near pages is told by line hashes."""
    near = Window.partitionBy("range").orderBy(*ORDER)
    told = F.struct("lines", F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))
    beside = [F.when(at("host", k).over(near) == F.col("host"), at(told, k).over(near)) for k in range(1, NEAR + 1) for at in (F.lag, F.lead)]
    ranged = _in_ranges(_keyed(parsed).drop("blocks"), NEAR)
    paired = ranged.withColumn("others", F.filter(F.array(*beside), lambda x: x.isNotNull())).filter(~F.col("lent") & (F.size("others") >= NEAR))
    # a line that one of them lacks is on no alignment with it
    some = paired.filter(F.size(F.aggregate("others", F.col("lines"), lambda x, o: F.array_intersect(x, o["lines"]))) > 0)
    gone = checkpoint(some.select("row", _template("lines", "sizes", "others").alias("gone")).filter(F.exists("gone", lambda x: x)))
    few = gone.count() <= FEW
    kept = F.when(F.col("gone").isNull() | F.forall("gone", lambda x: x), F.col("blocks")).otherwise(F.filter("blocks", lambda _, i: ~F.get("gone", i)))
    return parsed.join(F.broadcast(gone) if few else gone, "row", "left").select("page_id", "url", F.array_join(kept, "\n").alias("text"), "marked", F.size("blocks").cast("long").alias("n_lines"))


def extract_html(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", difference_marked: bool = False) -> DataFrame:
    """Main text of every page: id, url, text, marked (the page marks its article), n_lines (before differencing)."""
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html"))
    parsed = checkpoint(rows.mapInPandas(_parse, "page_id long, url string, blocks array<string>, marked boolean").withColumn("row", F.monotonically_increasing_id()))
    keyed = _keyed(parsed if difference_marked else parsed.filter("not marked"))
    near = Window.partitionBy("range").orderBy(*ORDER)
    told = F.struct("lines", "sizes", "marked")
    beside = lambda at: F.when(at("host").over(near) == F.col("host"), at(told).over(near))
    none = F.struct(F.lit(None).cast("array<long>").alias("lines"), F.lit(None).cast("array<int>").alias("sizes"), F.lit(None).cast("boolean").alias("marked"))
    paired = _in_ranges(keyed).withColumns({"before": F.coalesce(beside(F.lag), none), "after": F.coalesce(beside(F.lead), none)}).filter(~F.col("lent"))
    cut = paired.select("page_id", "url", _difference("blocks", "lines", "marked", "before", "after").alias("text"), "marked", F.size("blocks").cast("long").alias("n_lines"))
    if not difference_marked:
        cut = cut.unionByName(_marked_text(parsed.filter("marked")))
    return cut.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "marked", "n_lines")
