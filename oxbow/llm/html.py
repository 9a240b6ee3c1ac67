"""The main text of web pages, by two passes of block rules.

The page is cut into blocks at block-level tags.  The first pass classifies each block by its container, link
density, length and stop-word density: blocks in navigation, headers, footers, sidebars, notices, adverts, forms and
reader comments, and blocks of links, are bad; long blocks with many stop words are good, ones with few are bad;
others are ambiguous: near-good or short.  The second pass gives each ambiguous block the class of its nearest decided
neighbours: good between two good ones; between a good and a bad one the nearer one's, near-good blocks
counting as good; headings take the class of what follows.

An article (or main) element is one feature among these: its blocks are one class better (bad, short, near-good, good)
than their length and stop words say, and their neighbours are the article's other blocks, its ends counting as good.
Blocks outside of it are classified like those of any page.

Where under STOP_LOW of the words of a page's candidate blocks are stop words, the lists lack its language and tell
nothing: length and links decide there.

The parser is one pass of a regular expression over tags; unclosed tags end with their container, as block starts close open
paragraphs.  Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by newlines in page order.

Defined results: a null, empty or text-less page has empty text.  Text outside of any block, and pages cut off in the
middle of a tag, are read as far as they go.  Repeated pages give repeated rows; an empty table none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read

#: Words of at least one of the languages that are told apart; what counts is their share of a block's words.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you "
    "le la les un une des du de et est en que qui dans pour pas par sur au aux avec ce se ne il elle ou son sa ses plus "
    "der die das den dem des ein eine einen und ist in zu von mit auf für nicht auch sich als an im es er sie wir "
    "el los las una y es que del se con por para su lo al como más o pero sus".split()
)
LINK_DENSITY, SHORT, LONG, STOP_LOW, STOP_HIGH, NEAREST = 0.5, 70, 200, 0.10, 0.20, 200

#: In a tag a quote opens a value only after "="; one that nothing closes is part of the value.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption button dialog head fieldset input label".split())
#: Elements whose text is never the article's.
_BAD = set("nav footer aside form menu button select dialog head fieldset input label".split())
_BAD_ROLE = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = (
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|newsletter|subscri\w*|signup|login|paywall|side-?bar|widgets?|nav\w*|menu\w*|"
    r"breadcrumbs?|footer|masthead|site-?header|page-?header|topbar|toolbar|comments?|disqus|respond|replies|share|sharing|social|related|recommend\w*|popup|modal|overlay|pagination|pager|tags|tagcloud|skip-?link|search\w*"
)
#: Names of containers, also as a part of one; of elements with text of their own, as the last part.
_BAD_NAME = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?=$|[\s_-])", re.I)
_BAD_TEXT_NAME = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?=$|\s)", re.I)
_TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption span b i em strong a code".split())
#: Names of articles that are none: only as a whole name, as an article's may tell what stands beside it.
_BAD_ARTICLE = re.compile(r"(?:^|\s)(?:ads?|advert|advertisement|sponsored|promo|comments?|reply|replies|teaser|related)(?=$|\s)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What an article's block is instead of what its length and stop words say.
_LIFTED = {"bad": "short", "short": "neargood", "neargood": "good", "good": "good"}
_HEADING = re.compile("h[1-6]$")
_WORDS = re.compile(r"[^\W\d_]+")


class Block:
    """One block: its text, how many of its characters are in links, and where it stands."""

    __slots__ = ("article", "bad", "heading", "links", "text", "verdict")

    def __init__(self, text: str, links: int, bad: bool, article: bool, heading: bool):
        self.text, self.links, self.bad, self.article, self.heading, self.verdict = text, links, bad, article, heading, ""


def _is_hidden(attributes: str) -> bool:
    if "hidden" not in attributes.lower() and "none" not in attributes.lower():
        return False
    return any(m[1].lower() == "hidden" or (m[1].lower() == "style" and _HIDDEN.search(m[2] or m[3] or m[4] or "")) for m in _ATTRIBUTE.finditer(attributes))


def _is_bad(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _BAD or (tag == "header" and not in_article) or _is_hidden(attributes):
        return True
    if "=" in attributes and tag not in ("body", "html"):
        names = _BAD_ARTICLE if tag in ("article", "main") else _BAD_TEXT_NAME if tag in _TEXT_TAGS else _BAD_NAME
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if (name == "role" and value.lower() in _BAD_ROLE) or (name in ("class", "id", "itemprop") and names.search(value)):
                return True
    return False


class _Parser:
    """One pass over a page's tags; blocks: those with text, in order."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, bool, bool]] = []  # open elements: tag, bad, article
        self.text: list[tuple[str, bool]] = []  # of the block so far, and whether in a link
        self.link: int | None = None  # how many elements were open where the open link began
        self.muted: list[str] = []  # an open inline element without a text, and the same inside it
        self.breaks = 0

    def end_block(self) -> None:
        self.breaks = 0
        if self.text:
            whole = " ".join(entities.unescape("".join(t for t, _ in self.text)).split())
            if whole:
                links = sum(len(" ".join(entities.unescape(t).split())) for t, linked in self.text if linked)
                heading = any(_HEADING.match(t) for t, _, _ in self.stack[-3:])
                bad, article = self.state()
                self.blocks.append(Block(whole, links, bad, article, heading))
            self.text.clear()

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def put(self, text: str) -> None:
        if text and not self.muted:
            self.text.append((text, self.link is not None))
            if text.strip():
                self.breaks = 0

    def tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag in _BLOCK:
            self.end_block()
            self.muted.clear()
            if tag not in _VOID:
                self.close(tag) if closing else self.open(tag, attributes)
        elif tag == "br":
            self.breaks += 1
            self.put(" ")
            if self.breaks > 1:
                self.end_block()
        elif tag in _VOID:
            return
        elif self.muted:
            if tag == self.muted[-1]:
                self.muted.pop() if closing else self.muted.append(tag)
        elif not closing and (_is_bad(tag, attributes, self.state()[1]) if tag == "span" else _is_hidden(attributes)):
            self.muted.append(tag)
        elif tag == "a":
            self.link = None if closing else len(self.stack)

    def open(self, tag: str, attributes: str) -> None:
        if self.stack and (self.stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "td", "th", "tr", "option") and self.stack[-1][0] == tag)):
            self.pop(len(self.stack) - 1)
        bad, article = self.state()
        self.stack.append((tag, bad or _is_bad(tag, attributes, article), article or tag in ("article", "main")))

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag not in ("p", "li") or not any(t in ("article", "nav", "footer", "aside", "main", "form") for t, _, _ in self.stack[k + 1 :]):
                    self.pop(k)
                break

    def pop(self, to: int) -> None:
        """Closes all elements but the first; a link that began in one of them ends with it."""
        del self.stack[to:]
        if self.link is not None and self.link > to:
            self.link = None


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, those without text left out."""
    parser, pos, size = _Parser(), 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if m is None:
            parser.put(page[pos:])
            break
        parser.put(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in _RAW and not m[1]:
            if not m[0].endswith("/>"):
                end = _RAW_END[tag].search(page, pos)
                pos = end.end() if end else size
            continue
        parser.tag(tag, bool(m[1]), m[3])
    parser.end_block()
    return parser.blocks


def _density(b: Block) -> float:
    return b.links / max(1, len(b.text))


def _stop_words(text: str) -> tuple[int, int]:
    """How many of the text's words are stop words, and how many words it has."""
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _first_pass(blocks: list[Block]) -> None:
    counts = [(0, 0) if b.bad or _density(b) > LINK_DENSITY else _stop_words(b.text) for b in blocks]
    listed = sum(s for s, _ in counts) >= STOP_LOW * sum(n for _, n in counts)
    for b, (s, n) in zip(blocks, counts, strict=True):
        dense = _density(b)
        if b.bad or (dense > LINK_DENSITY and not b.heading and not b.article):
            b.verdict = "bad"
            continue
        if dense > LINK_DENSITY and b.article:  # a list of links in an article is its text, unless it stands apart
            b.verdict = "short"
            continue
        stop = s / max(1, n) if listed else 1.0
        if len(b.text) < SHORT:
            b.verdict = "short" if dense == 0 or b.article else "bad"
        elif stop >= STOP_HIGH:
            b.verdict = "good" if len(b.text) > LONG else "neargood"
        else:
            b.verdict = "neargood" if stop >= STOP_LOW else "bad"
        if b.article:
            b.verdict = _LIFTED[b.verdict]


def _neighbours(blocks: list[Block], told: list[str], edge: str) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """The class of, and the characters to, the nearest decided block before and after each."""
    sides = []
    for way in (1, -1):
        side, last = [], (edge, 0)
        for b, t in zip(blocks[::way], told[::way], strict=True):
            last = (t, 0) if t else (last[0], last[1] + len(b.text))
            side.append(last)
        sides.append(side[::way])
    return zip(*sides, strict=True)


def _second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks inherit from their nearest decided neighbours."""
    told = [b.verdict if b.verdict in ("good", "bad") else "" for b in blocks]
    if "good" not in told:  # nothing is surely good: the best candidates decide
        told = ["good" if b.verdict == "neargood" else t for b, t in zip(blocks, told, strict=True)]
        if "good" not in told:
            told = ["good" if b.verdict == "short" else t for b, t in zip(blocks, told, strict=True)]
    around = list(_neighbours(blocks, told, "bad"))
    inside = [k for k, b in enumerate(blocks) if b.article and not b.bad]
    for k, x in zip(inside, _neighbours([blocks[k] for k in inside], [told[k] for k in inside], "good"), strict=True):
        around[k] = x
    for b, t, ((up, far_up), (down, far_down)) in zip(blocks, told, around, strict=True):
        if t:
            b.verdict = t
        elif up == down:
            b.verdict = up
        elif b.heading:
            b.verdict = "good" if down == "good" and (b.article or far_down <= NEAREST + len(b.text)) else "bad"
        elif b.verdict == "neargood":
            b.verdict = "good"
        else:
            b.verdict = up if far_up <= far_down else down


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    _first_pass(blocks)
    _second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.verdict == "good")


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
