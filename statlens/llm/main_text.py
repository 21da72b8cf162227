"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score by the zone they stand in
(article, plain body, menu, footer, advert ...), by whether they are a link and, where
the page names no zone, by the block they stand in (paragraph, list item, bare div ...);
tags score below zero.  A linear scan finds the contiguous stretch with the
largest sum, and its blocks, without those in zones that are never content, are
the text; in plain body, blocks of a kind that is rarely content are left out as well.
Weights are log odds of standing inside the content, counted on a
bounded sample of pages (``SAMPLE`` expected, by a hash of the page id) that
label it themselves with a single article or main element; ``PRIOR`` counts
stand in where no page does.  A page whose words are all in blocks that are rarely
content is scanned again without the blocks' weights.

A header inside an article is the article's own: its headings are content, the rest
is not.

Defined cases: NULL html is empty and gives the empty text, as does a page
without a word in its content; cut or unclosed markup ends where the page ends;
very long pages are read whole, in linear time; ties go to the earliest and then
shortest stretch; rows are read one by one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.llm.common import with_text_columns

SAMPLE = 2000
PRIOR = 20
LIMIT = 3.0

# HTML's element names by their role.
BLOCKS = frozenset("""address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead
    tr ul""".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = frozenset("br wbr img hr input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ZONES = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "select": "form",
         "head": "head", "article": "content", "main": "content", "dialog": "notice"}
OPEN = frozenset(("content", "body", "beside"))  # zones that can be content
#: Words in class, id and role names that make an element a zone.
NAMES = {w: zone for zone, names in {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs toolbar",
    "header": "header masthead topbar banner contentinfo", "footer": "footer copyright colophon",
    "aside": "sidebar aside widget related recommended share sharing social complementary tags",
    "advert": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion promoted",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer",
    "form": "form newsletter subscribe subscription signup login search",
    "comments": "comment comments respond disqus replies discussion"}.items() for w in names.split()}
NEVER = frozenset("html body article main p h1 h2 h3 h4 h5 h6 span b i em strong".split())  # class names there aren't zones ...
LOUD = frozenset(("advert", "notice", "comments"))  # ... but for these on p and span
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SPLIT = re.compile(r"[^a-z0-9]+")


def zone_of(tag: str, attributes: str) -> str | None:
    zone = ZONES.get(tag, "heading" if tag in HEADINGS else None)
    if attributes and tag not in ("html", "body", "article", "main"):
        for _, value in ATTRIBUTE.findall(attributes):
            for w in SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()):
                named = NAMES.get(w)
                if named and (tag not in NEVER or named in LOUD):
                    return named
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes, re.I):
            return "notice"
    return zone


def tag_end(page: str, at: int) -> int:
    """Where a tag that begins at ``at`` closes; quoted values may hold a >."""
    end = page.find(">", at)
    if end < 0:
        return -1
    quote = None
    k = at
    while k < end:
        q1, q2 = page.find('"', k, end), page.find("'", k, end)
        q = min(x for x in (q1, q2, end) if x >= 0)
        if q == end:
            break
        if page[q - 1:q] != "=" and page[max(at, q - 2):q].strip() != "=":
            k = q + 1
            continue
        quote = page.find(page[q], q + 1)
        if quote < 0:
            break
        k = quote + 1
        if k > end:
            end = page.find(">", k)
            if end < 0:
                return -1
    return end


def events(page: str):
    """(kind, value, zone, link): kind "t" text, "+" opening tag, "-" closing."""
    low = None
    at, n = 0, len(page)
    zones: list[list] = []  # [zone, tag, depth of that tag]
    link = 0
    zone = "body"
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "t", page[at:lt], zone, link > 0
        if lt == n:
            return
        head = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4 if not page.startswith("<!-->", lt) else lt + 2)
            at = n if end < 0 else end + 3
            continue
        if head in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = head == "/"
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:  # a bogus comment
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "t", "<", zone, link > 0
                at = lt + 1
            continue
        end = tag_end(page, m.end())
        if end < 0:
            return
        tag = m[0].lower()
        at = end + 1
        if closing:
            yield "-", tag, zone, link > 0
            if tag == "a":
                link = max(0, link - 1)
            for k in range(len(zones) - 1, -1, -1):
                if zones[k][1] == tag:
                    zones[k][2] -= 1
                    if not zones[k][2]:
                        del zones[k:]
                    break
            zone = _zone(zones)
            continue
        attributes = page[m.end():end]
        if tag in RAW:
            if not attributes.endswith("/"):
                low = low or _lower(page)
                end = low.find("</" + tag, at)
                if end < 0:
                    return
                at = end
            yield "+", tag, zone, link > 0
            continue
        if tag in ("p", "li") or tag in BLOCKS:  # an unclosed <p> or <li> of a zone ends here
            while zones and zones[-1][1] in ("p", "li") and (zones[-1][1] == "p" or tag == "li"):
                zones.pop()
            zone = _zone(zones)
        new = zone_of(tag, attributes)
        if tag not in VOID and not attributes.endswith("/"):
            if tag == "a":
                link += 1
            if new:
                zones.append([new, tag, 1])
                zone = _zone(zones)
            else:
                for z in reversed(zones):
                    if z[1] == tag:
                        z[2] += 1
                        break
        yield "+", tag, zone, link > 0


def _lower(page: str) -> str:
    low = page.lower()
    return low if len(low) == len(page) else "".join(c.lower() if c < "\x80" else c for c in page)


def _zone(zones: list[list]) -> str:
    """The zone in force: the outermost that is never content ("inset" where it
    stands in an article), else the inmost.  A heading in an article's own header is content."""
    if [z[0] for z in zones[-3:]] == ["content", "header", "heading"] and all(z[0] in OPEN for z in zones[:-3]):
        return "content"
    for k, z in enumerate(zones):
        if z[0] not in OPEN and z[0] != "heading":
            return "inset" if k else z[0]
    inmost = [z[0] for z in zones if z[0] != "heading"]
    return inmost[-1] if inmost else "body"


def in_blocks(found: list[tuple[str, str, str, bool]]):
    """The events with the block element that each stands in ("" outside of all)."""
    open_: list[str] = []
    for kind, value, zone, link in found:
        if kind != "t" and value in BLOCKS and value not in VOID:
            if kind == "+":
                while open_ and (open_[-1] == "p" or open_[-1] == value == "li"):  # closed by what opens
                    open_.pop()
                open_.append(value)
            elif value in open_:
                while open_.pop() != value:
                    pass
        yield kind, value, zone, link, open_[-1] if open_ else ""


def feature(kind: str, value: str, zone: str, link: bool) -> str:
    if kind == "t":
        return f"word {zone}{' link' if link else ''}"
    return f"tag {value if value in BLOCKS or value in RAW or value in VOID or value in ('a', 'b', 'i', 'em', 'strong', 'span') else 'other'}"


def marked(page: str) -> list[tuple[str, str, str, bool]]:
    """The page's events; plain body beside an article or main is a zone of its own."""
    found = list(events(page))
    if any(kind == "+" and value in ("article", "main") for kind, value, _, _ in found):
        found = [(k, v, "beside" if z == "body" else z, a) for k, v, z, a in found]
    return found


def tally(page: str) -> dict[str, list[int]]:
    """For a page that labels its content, counts of each feature inside and
    outside; empty for other pages."""
    inside = Counter()
    outside = Counter()
    depth = seen = 0
    for kind, value, zone, link, block in in_blocks(marked(page)):
        if kind != "t" and value in ("article", "main"):
            seen += kind == "+"
            depth += 1 if kind == "+" else -1
            continue
        n = len(value.split()) if kind == "t" else 1
        if n:
            side = inside if depth > 0 and zone in OPEN else outside
            side[feature(kind, value, zone, link)] += n
            if kind == "t":
                side[f"block {block}"] += n
    if seen != 1:
        return {}
    return {f: [inside[f], outside[f]] for f in inside | outside}


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Scores of features from counts (inside, outside) and the prior's."""
    out = {}
    zones = ["body", "beside", "content", "inset", *sorted(set(ZONES.values()) | set(NAMES.values()))]
    names = {f"word {z}{k}" for z in zones for k in ("", " link")} | set(counts)
    for f in names:
        i, o = counts.get(f, (0, 0))
        if f.startswith("block "):
            out[f] = max(-LIMIT, min(LIMIT, math.log((i + PRIOR / 2) / (o + PRIOR / 2))))
        elif f.startswith("word "):
            zone = f.split()[1]
            share = {"content": 0.9, "body": 0.7}.get(zone, 0.05)
            if f.endswith("link"):
                share *= 0.6
            odds = math.log((i + PRIOR * share) / (o + PRIOR * (1 - share)))
            # Zones that are never content are left out anyway; their words must not
            # cut a text in two.
            out[f] = max(-LIMIT, min(LIMIT, odds)) if zone in OPEN else -0.02 if zone == "inset" else -0.5
            if zone == "content":  # what a page itself calls content is never below zero
                out[f] = max(out[f], 0.1)
            if f == "word body":  # plain text may be the content of other pages
                out[f] = max(out[f], 0.5)
        else:
            out[f] = -0.1 - min(LIMIT, math.log1p(o / (i + 1.0)))
    return out


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The blocks of the best stretch, joined by line feeds."""
    found = list(in_blocks(marked(page or "")))
    text = _best(found, weight, True)
    return text or _best(found, weight, False)


def _best(found: list[tuple[str, str, str, bool, str]], weight: dict[str, float], by_block: bool) -> str:
    best, total, start = 0.0, 0.0, 0
    stretch = (0, 0)
    for k, (kind, value, zone, link, block) in enumerate(found):
        n = len(value.split()) if kind == "t" else 1
        w = weight.get(feature(kind, value, zone, link), -0.1)
        if by_block and kind == "t" and zone == "body":
            w += weight.get(f"block {block}", 0.0)
        total += n * w
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, stretch = total, (start, k + 1)
    blocks: list[list[str]] = [[]]
    for kind, value, zone, link, block in found[stretch[0]:stretch[1]]:
        if kind == "t":
            rare = by_block and zone == "body" and weight.get(feature(kind, value, zone, link), -0.1) + weight.get(f"block {block}", 0.0) < 0
            if zone in OPEN and not rare:
                blocks[-1].append(entities.unescape(value))  # a reference ends with its run of text
        elif value in BLOCKS:
            blocks.append([])
        elif value in SPACE:
            blocks[-1].append(" ")
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from a bounded sample of ``pages`` (page_id, html)."""
    n = pages.count()
    draw = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) / float(1 << 30)

    def rows(batches):
        total: dict[str, list[int]] = {}
        for b in batches:
            for page in b.column(0):
                for f, (i, o) in tally(page.as_py() or "").items():
                    t = total.setdefault(f, [0, 0])
                    t[0] += i
                    t[1] += o
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t[0] for t in total.values()], pa.int64()),
                                          pa.array([t[1] for t in total.values()], pa.int64())], ["f", "i", "o"])

    counts = (pages.filter(draw < min(1.0, sample / max(n, 1))).select("html").mapInArrow(rows, "f string, i long, o long")
              .groupBy("f").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).collect())  # names of tags and zones
    return weights({r["f"]: (r["i"], r["o"]) for r in counts})


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) to page_id, url, text and n_chars."""
    w = fit(pages)

    def made(found):
        texts = [extract(page, w) for page in found]
        return [texts, [len(t) for t in texts]]

    out = with_text_columns(pages.select("page_id", "url", "html"), made, [("_mt_text", "string"), ("_mt_n", "long")], text="html", rows=64)
    return out.select("page_id", "url", F.col("_mt_text").alias("text"), F.col("_mt_n").alias("n_chars"))
