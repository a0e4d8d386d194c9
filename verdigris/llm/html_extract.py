"""HTML extraction by the maximum-scoring contiguous region.

A page becomes blocks of words with the tags between them. Scripts, styles and
other raw elements are no text, and page furniture by tag, role or an unmistakable
class or id is cut. Each word of a block scores by what the block is: its kind and
share of linked words, its length, a doubtful name around it, and whether it lies
in an article or main element; a heading counts like what it heads; tags score negative. The weights of kinds and lengths are log odds
of words inside and outside of the article, counted on labelled pages, those with exactly
one article element, with priors for kinds that those lack. One linear scan finds
the contiguous region with the highest sum; its blocks are the text. A page without
any positive word is scanned again, first without names, then by links alone.

Inside of an article every word is positive unless it is cut, so pages that mark
their article keep it whole; on other pages the scan decides alone. What lies between
two positive blocks costs a bounded sum, so that images, markup or a list of links
never part a text.

Weights come from about `sample_pages` pages of at most `sample_chars`
characters; all pages are then read whole by Spark tasks. Null and empty pages,
and pages without words, give an empty text. Broken markup never fails: end tags
that HTML lets out are implied, other unclosed elements end with their parent,
unclosed furniture ends before the next container. Repeated
rows are extracted alike. Only page_id, url and html are read.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._shared import ship, small_batches, table

RAW = frozenset("script style noscript template iframe svg object canvas audio video textarea title select datalist".split())
#: Raw elements that run to the page's end if they aren't closed; of others only the tag goes.
CODE = frozenset("script style".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)", re.DOTALL)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption head".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("head nav footer aside form button menu dialog fieldset".split())
CONTAINERS = frozenset("article section div ul ol dl table".split())
KINDS = dict.fromkeys(HEADINGS, "heading") | dict.fromkeys("td th caption".split(), "cell") | dict.fromkeys("dt dd".split(), "entry") | dict.fromkeys("blockquote pre figcaption p li".split(), "")
#: What may stand in a head, and tags that end an open element of the second set, looked for up to the third.
IN_HEAD = frozenset("base link meta".split())
IMPLIED = {tag: (frozenset({"p"}), BLOCK - {"p"}) for tag in BLOCK - frozenset("body html head li dt dd tr td th tbody thead tfoot caption summary".split())}
IMPLIED |= {"li": (frozenset({"li"}), BLOCK - frozenset("li div p address".split()))} | dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd"}), BLOCK - frozenset("dt dd div p address".split())))
IMPLIED |= {"tr": (frozenset({"tr"}), frozenset({"table"}))} | dict.fromkeys(("td", "th"), (frozenset({"td", "th"}), frozenset({"table", "tr"}))) | dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})))
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Names that say what a container is, and names that content may have too.
CLEAR = re.compile(
    r"(?:^|[\s_])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|cookies?|consent|gdpr|popup|modal|sidebar|navbar|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|disqus|respond|newsletter|subscribe|subscription|pagination|pager|"
    r"(?:cookie|site|page|main|global|top|side|left|right|comment|related|share|social|newsletter|legal)-(?:notice|banner|header|footer|nav|navigation|menu|bar|column|list|links|posts|articles|buttons|box|form|section|area))(?:$|[\s_-])",
    re.IGNORECASE,
)
DOUBTFUL = re.compile(
    r"(?:^|[\s_-])(?:promos?|promotion|banner|notices?|notification|alert|overlay|side|menu|nav|navigation|header|replies|reply|discussion|share|sharing|social|related|recommended|signup|login|search|widget|toolbar|skip|legal|copyright|teasers?|footer|sidebar|comments?|ads?|newsletter)(?:$|[\s_-])",
    re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
SPACE = re.compile(r"\s+")
TAG_COST, MOST_COST = 0.05, 8.0
#: Weights of a word before anything is counted, by the kind and linked words of its block, and by its length.
PRIOR = {("p", "none"): 1.0, ("p", "some"): 0.8, ("p", "most"): -0.4, ("heading", "none"): 0.8, ("heading", "some"): 0.4, ("heading", "most"): -0.4, ("box", "none"): 0.3, ("box", "most"): -1.2, "short": -0.3, "middle": 0.1, "long": 0.6}
BY_LINK = {"none": 0.6, "some": 0.2, "most": -1.0}
DOUBT, IN_CORE, OUT_OF_CORE = -1.2, 4.0, -3.0


def attributes(attrs: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'")) for name, value in ATTRIBUTE.findall(attrs)] if attrs else []


def is_furniture(tag: str, attrs: str, in_article: bool) -> bool:
    """By tag, role or hidden. Inside of an article a header belongs to it."""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main"):
        return False
    return any(name == "hidden" or (name == "role" and value.lower() in FURNITURE_ROLES) for name, value in attributes(attrs))


def named(tag: str, attrs: str, names: re.Pattern) -> bool:
    if tag in ("html", "body", "main"):
        return False
    return any(name in ("class", "id") and names.search(value) for name, value in attributes(attrs))


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, value, attributes): kind is open, close or text. A self-closed raw element ends at once, and the end of each kind is looked for once."""
    out, at, endless = [], 0, set()

    def text(end: int) -> None:
        if end > at:
            out.append(("text", page[at:end], ""))

    for_raw: dict[str, re.Pattern] = {}
    m = TOKEN.search(page)
    while m:
        text(m.start())
        at = m.end()
        if m["tag"]:
            tag, attrs = m["tag"].lower(), m["attrs"] or ""
            if tag in RAW:
                if not m["end"] and not attrs.endswith("/"):
                    found = None
                    if tag not in endless:
                        found = for_raw.setdefault(tag, re.compile(rf"</{tag}\s*+>", re.IGNORECASE)).search(page, at)
                    if found:
                        at = found.end()
                    elif tag in CODE:
                        at = len(page)
                    else:
                        endless.add(tag)
            else:
                out.append(("close" if m["end"] else "open", tag, attrs))
        m = TOKEN.search(page, at)
    text(len(page))
    return out


def ends(found: list[tuple[str, str, str]]) -> tuple[dict[int, int], dict[int, int]]:
    """Last token of each element: by its own end tag, and by implication."""
    closes: dict[int, int] = {}
    implied: dict[int, int] = {}
    stack: list[int] = []
    open_tags: Counter = Counter()

    def pop_to(depth: int, last: int) -> None:
        for j in stack[depth:]:
            implied[j] = last
            open_tags[found[j][1]] -= 1
        del stack[depth:]

    for i, (kind, value, _) in enumerate(found):
        if open_tags["head"] and ((kind == "open" and value not in IN_HEAD) or (kind == "text" and value.strip())):
            pop_to(next(d for d, j in enumerate(stack) if found[j][1] == "head"), i - 1)
        if kind == "open":
            wanted, stops = IMPLIED.get(value, (frozenset(), frozenset()))
            if any(open_tags[t] for t in wanted):
                for depth in range(len(stack) - 1, -1, -1):
                    tag = found[stack[depth]][1]
                    if tag in wanted:
                        pop_to(depth, i - 1)
                    if tag in wanted or tag in stops:
                        break
            if value not in VOID:
                stack.append(i)
                open_tags[value] += 1
        elif kind == "close" and open_tags[value]:
            depth = next(d for d in range(len(stack) - 1, -1, -1) if found[stack[d]][1] == value)
            pop_to(depth + 1, i - 1)
            closes[stack.pop()] = i
            open_tags[value] -= 1
    return closes, implied


@dataclass
class Block:
    """Words up to the next block-level tag: text, how many words and linked words, the nearest block's tag, tags before it, and what lies around it."""

    tag: str
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    tags: int = 0
    core: bool = False
    doubtful: bool = False

    def features(self) -> tuple[tuple[str, str], str]:
        kind = KINDS.get(self.tag, "box") or self.tag
        link = "none" if not self.linked else "most" if 2 * self.linked >= self.words else "some"
        return (kind, link), "short" if self.words < 4 else "middle" if self.words < 12 else "long"


def blocks_of(page: str, cut: bool = True, names: bool = True) -> tuple[list[Block], bool]:
    """The page's blocks with words outside of furniture, and whether it marks an article or main. Without `cut` furniture is kept, for counting."""
    found = tokens(page)
    closes, implied = ends(found)
    counts = list(accumulate((len(value.split()) if kind == "text" else 0 for kind, value, _ in found), initial=0))
    opened = [i for i, (kind, value, _) in enumerate(found) if kind == "open" and value in ("article", "main")]
    cores = [i for i in opened if found[i][1] == "main" or not (is_furniture("article", found[i][2], False) or named("article", found[i][2], CLEAR) or named("article", found[i][2], DOUBTFUL))]
    own = {"article"} if any(found[c][1] == "article" for c in cores) else {"main"}
    titles = [i for i, (kind, value, _) in enumerate(found) if kind == "open" and value == "h1"]
    nexts = [i for i, (kind, value, _) in enumerate(found) if kind == "open" and (value in CONTAINERS or value == "main")]

    def last(i: int) -> int:
        if i in closes:
            return closes[i]
        at = bisect.bisect_right(nexts, i)
        return min(implied.get(i, len(found)), nexts[at] - 1 if at < len(nexts) else len(found))

    def holds(i: int, places: list[int]) -> bool:
        at = bisect.bisect_right(places, i)
        return i in closes and at < len(places) and places[at] < closes[i]

    def gone(i: int, value: str, attrs: str, article: bool) -> bool:
        if is_furniture(value, attrs, article):
            whole = holds(i, cores) or (value in ("form", "fieldset") and (holds(i, titles) or 2 * (counts[min(last(i), len(found) - 1)] - counts[i]) > counts[-1]))
            return not whole or value in FURNITURE_TAGS - {"form", "fieldset"}
        return names and value in CONTAINERS and named(value, attrs, CLEAR) and not holds(i, cores) and not holds(i, titles)

    out: list[Block] = []
    stack: list[tuple[str, int]] = [("body", len(found))]
    current = Block("body")
    i, article, link, core, doubtful, tags, text_tags = 0, 0, 0, 0, -1, 0, 0

    def close() -> None:
        nonlocal current, tags
        if current.words:
            out.append(current)
            tags = 0
        current = Block(stack[-1][0])

    while i < len(found):
        kind, value, attrs = found[i]
        while len(stack) > 1 and stack[-1][1] < i:
            stack.pop()
            close()
        if kind == "open" and value not in VOID:
            if cut and gone(i, value, attrs, article > 0):
                close()
                i = last(i) + 1
                continue
            if names and not core and value not in HEADINGS and named(value, attrs, DOUBTFUL) and not holds(i, cores):
                doubtful = max(doubtful, last(i))
        if kind == "text":
            n = len(entities.unescape(value).split())
            if n and not current.words:
                current.core, current.doubtful, current.tags = core > 0, i <= doubtful, tags
            current.words += n
            current.linked += n if link else 0
            current.parts.append(value)
        else:
            step = (kind == "open") - (kind == "close")
            if value in ("article", "main"):
                article = max(0, article + step)
                core = max(0, core + step) if value in own else core
            if value == "a":
                link = max(0, link + step)
            if value not in VOID:
                tags += 1
            if value == "br":
                current.parts.append(" ")
            elif value in BLOCK:
                close()
                if kind == "open" and value not in VOID:
                    stack.append((value, closes.get(i, implied.get(i, len(found)))))
                    current = Block(value)
                elif kind == "close" and len(stack) > 1 and stack[-1][1] == i:
                    stack.pop()
                    current = Block(stack[-1][0])
        i += 1
    close()
    return out, bool(cores)


def learn_weights(pages: list[str]) -> dict:
    """Log odds of words inside of the article against outside, by kind and links and by length, shrunk to the priors and bounded."""
    inside, outside = Counter(), Counter()
    for page in pages:
        blocks, marked = blocks_of(page, cut=False)
        if not marked or len(re.findall(r"<article\b", page, re.IGNORECASE)) != 1:
            continue
        for b in blocks:
            for f in b.features():
                (inside if b.core else outside)[f] += b.words
    total_in, total_out = sum(inside.values()) / 2 + 1, sum(outside.values()) / 2 + 1
    weights = dict(PRIOR)
    for f in set(inside) | set(outside):
        odds = math.log((inside[f] + 5) / (total_in + 10)) - math.log((outside[f] + 5) / (total_out + 10))
        n, prior = inside[f] + outside[f], weights.get(f, BY_LINK[f[1]] if isinstance(f, tuple) else 0.0)
        bound = (-1.5, 1.2) if isinstance(f, tuple) else (-0.4, 0.6)
        weights[f] = (100 * prior + n * min(max(odds, bound[0]), bound[1])) / (100 + n)
    return weights


def word_weight(block: Block, weights: dict, marked: bool) -> float:
    what, size = block.features()
    score = weights.get(what, BY_LINK[what[1]]) + weights[size] + (DOUBT if block.doubtful else 0.0)
    return score + ((IN_CORE if block.core else OUT_OF_CORE) if marked else 0.0)


def block_scores(blocks: list[Block], weights: dict, marked: bool) -> list[float]:
    """Words times weight; a heading is worth no more a word than the block that it heads."""
    scores, headed = [0.0] * len(blocks), math.inf
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        weight = word_weight(b, weights, marked)
        if b.tag in HEADINGS:
            weight = min(weight - (DOUBT if b.doubtful else 0.0), headed)
        else:
            headed = weight
        scores[i] = b.words * weight
    return scores


def best_region(scores: list[float], gaps: list[float]) -> tuple[int, int]:
    """The contiguous blocks with the highest sum of scores less the gaps between them; (0, 0) if none is positive. All that lies between two positive blocks costs MOST_COST at most."""
    best, where, run, start, lost = 0.0, (0, 0), 0.0, 0, 0.0
    for i, (score, gap) in enumerate(zip(scores, gaps)):
        cost = min(MOST_COST - lost, gap - min(score, 0.0))
        run, lost = run - cost, lost + cost
        if run <= 0:
            run, start, lost = 0.0, i, 0.0
        if score > 0:
            run, lost = run + score, 0.0
            if run > best:
                best, where = run, (start, i + 1)
    return where


def extract(page: str | None, weights: dict) -> str:
    """The blocks of the best region, joined by two line feeds."""
    if not page:
        return ""
    lo = hi = 0
    for attempt in range(3):
        blocks, marked = blocks_of(page, names=attempt == 0)
        if attempt < 2:
            scores = block_scores(blocks, weights, marked)
        else:
            scores = [float(2 * (b.words - b.linked) - b.linked) for b in blocks]
        lo, hi = best_region(scores, [TAG_COST * b.tags for b in blocks])
        if hi > lo:
            break
    found = (SPACE.sub(" ", entities.unescape("".join(b.parts))).strip() for b in blocks[lo:hi])
    return "\n\n".join(b for b in found if b)


def fit_weights(pages: DataFrame, sample_pages: int = 300, sample_chars: int = 200_000) -> dict:
    """Weights from about sample_pages pages, those with the least hashes, and never more than twice as many."""
    rows = pages.filter(F.length("html") <= sample_chars).filter(F.col("html").contains("<article"))
    share = sample_pages / max(1, pages.count())
    place = F.shiftrightunsigned(F.xxhash64("html"), 11) / float(1 << 53)
    return learn_weights(sorted(r.html for r in rows.select("html").filter(place < share).limit(2 * sample_pages).collect()))


def extract_pages(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    spark = pages.sparkSession
    small_batches(spark)
    learned = fit_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, learned) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)
    out = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


#: For pages whose article holds nothing but headings, paragraphs and inline tags, as the given ones.
ORACLE_SQL = r"""SELECT page_id, url, text, len(text)::BIGINT AS n_chars FROM (SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)\b[^>]*>'),
 lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM pages)"""


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


ship(__name__)
