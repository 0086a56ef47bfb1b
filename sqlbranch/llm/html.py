"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides on a block by what it stands in, its link density,
its length and its density of stop words; short or doubtful blocks stay undecided. In the second pass those take the label
of the nearest decided neighbour in their part of the page; in an article, boilerplate has to stand on both sides.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names in HTML, and frequent words of four languages.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
SKIPPED_TAGS = frozenset("aside button dialog fieldset footer form head header menu nav search select title".split())
RAW_TAGS = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|audio|video"
CONTENT_TAGS = frozenset("article main".split())
CONTAINERS = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form head header main menu nav ol search section select table title ul".split())
SKIPPED_NAMES = frozenset("ad ads adbox advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer disqus footer header menu modal nav navbar navigation newsletter notice notification popup promo promoted promotion related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
#: Parts of names that tell of the state of the page around, such as has-sidebar or header-fixed.
WRAPPING_PARTS = frozenset("closed fixed has is layout no open with without".split())
STOP_WORDS = frozenset("""
a an and are as at be by for from had has he her his in is it not of on or she that the their they this to was were which with you
au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une
als am auf aus bei das dem den der die ein eine einer er es für im ist mit nicht sich sie und von war werden wie zu zum zur
al como con del el los las lo no para pero por se su sus una y
""".split())  # fmt: skip

#: A block is mostly links above this density; prose has at least this density of stop words; fewer characters than this are short, and more than that long.
LINKS, STOPS, SHORT, LONG = 0.33, 0.2, 70, 200

_RAW = frozenset(RAW_TAGS.split("|"))
_NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*+=\s*+["']?true|display\s*+:\s*+none""", re.I)
_TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*+")
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:[^"'<>]++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_UP_TO_MARK = re.compile(r"""[^"'>]*+""")
_RAW_END = {tag: re.compile(rf"</{tag}(?![a-zA-Z0-9])[^>]*>", re.I) for tag in _RAW}


class _Ends:
    """Finds the ends of tags with `<` in them, in a time that grows with the page's length however many have none."""

    def __init__(self, html: str):
        self.html, self.last, self.lost = html, max(map(html.rfind, "\"'>")), set()

    def of(self, at: int) -> int:
        """The place after a tag's `>`, quoted values passed over, or -1. A quote that was opened in vain isn't opened again."""
        html, passed = self.html, []
        while at <= self.last:
            at = _UP_TO_MARK.match(html, at).end()
            if html[at] == ">":
                return at + 1
            passed.append(at)
            at = html.find(html[at], at + 1) + 1 if at not in self.lost else 0
            if not at:
                break
        self.lost.update(passed)
        return -1


def pieces_of(html: str):
    """Text, and tags as (name, whether it ends an element, attributes), in order. Comments, declarations and raw elements with all they hold are left out.

    A tag or declaration that has no end is text; a comment or raw element without one goes to the end of the page.
    """
    at = start = 0
    n, last = len(html), html.rfind(">")
    ends = None
    while True:
        at = html.find("<", at)
        if at < 0 or at > last and not html.startswith("<!--", at):
            at = html.find("<!--", at) if at >= 0 else -1
            if at < 0:
                break
        tag = _TAG.match(html, at)
        if tag:
            ending, name, attributes = tag.groups()
            end = tag.end()
        elif html.startswith("<!--", at):
            if at > start:
                yield html[start:at]
            end = html.find("-->", at + 4)
            at = start = n if end < 0 else end + 3
            continue
        elif html.startswith(("<!", "<?"), at):
            if at > start:
                yield html[start:at]
            at = start = html.index(">", at) + 1
            continue
        else:
            found = _TAG_NAME.match(html, at + 1 + html.startswith("/", at + 1))
            ends = ends or _Ends(html)
            end = ends.of(found.end()) if found else -1
            if end < 0:
                at += 1
                continue
            ending, name, attributes = html[at + 1 : found.start()], found[0], html[found.end() : end - 1]
        if at > start:
            yield html[start:at]
        name = name.lower()
        if name in _RAW and not ending:
            close = _RAW_END[name].search(html, end, last + 1)
            at = start = close.end() if close else n
            continue
        yield name, ending == "/", attributes
        at = start = end
    if start < n:
        yield html[start:]


def _named(tag: str, attributes: str) -> bool:
    """Whether a class, id or role names something beside the text. A name counts as a whole or by its first or last part, but not if another part says that it is about the page around."""
    if tag in ("html", "body") or not attributes.strip():
        return False
    for found in _NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
            if parts and not WRAPPING_PARTS.intersection(parts) and (parts[0] in SKIPPED_NAMES or parts[-1] in SKIPPED_NAMES):
                return True
    return bool(_HIDDEN.search(attributes))


class Block:
    __slots__ = ("text", "linked", "part", "skipped", "heading", "named", "_stops")

    def __init__(self, text: str, linked: int, part: int, skipped: bool, heading: bool, named: tuple):
        self.text, self.linked, self.part, self.skipped, self.heading, self.named, self._stops = text, linked, part, skipped, heading, named, None

    @property
    def density(self) -> float:
        """Share of the text inside links."""
        return self.linked / max(1, len(self.text) - self.text.count(" ")) if self.linked else 0.0

    @property
    def stops(self) -> float:
        """Share of stop words."""
        if self._stops is None:
            words = self.text.lower().split()
            self._stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        return self._stops


class _Opened(list):
    """Open containers: (tag, whether its kind is skipped, its number if its name is, whether it is content). Counts are kept, so that no block looks at all of them."""

    def __init__(self):
        super().__init__()
        self.skipped = self.content = 0
        self.named: list[int] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, skipped: bool, named: int, content: bool) -> None:
        self.places.setdefault(tag, []).append(len(self))
        self.append((tag, skipped, named, content))
        self.skipped += skipped
        self.content += content
        if named:
            self.named.append(named)

    def cut(self, to: int) -> None:
        while len(self) > to:
            tag, skipped, named, content = self.pop()
            self.places[tag].pop()
            self.skipped -= skipped
            self.content -= content
            if named:
                self.named.pop()


def blocks_of(html: str) -> list[Block]:
    """Blocks with words, in page order. part: 0 outside of article and main elements, else the number of the outermost; named: the numbers of the containers around that are skipped by name."""
    out: list[Block] = []
    opened = _Opened()
    pieces: list[tuple[str, bool]] = []
    parts = links = numbers = 0
    heading = False

    def close():
        if pieces:
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                linked = sum(len("".join(t.split())) for t, in_link in pieces if in_link)
                out.append(Block(text, linked, parts if opened.content else 0, opened.skipped > 0, heading, tuple(opened.named[:8])))
            pieces.clear()

    for piece in pieces_of(html):
        if isinstance(piece, str):
            pieces.append((unescape(piece), links > 0))
            continue
        tag, ending, attributes = piece
        if tag == "br":
            pieces.append((" ", False))
        elif tag == "a":
            links = max(0, links - 1) if ending else 1
        elif tag in BLOCK_TAGS:
            close()
            links = 0 if tag not in ("li", "td", "th") or ending else links
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not ending
            if ending:
                if opened.places.get(tag):
                    opened.cut(opened.places[tag][-1])
                continue
            content = tag in CONTENT_TAGS
            if content and not opened.content:
                parts += 1
                held = [o for o in opened if not o[1] and not o[2]]  # what was left open before doesn't hold the article
                opened.cut(0)
                for o in held:
                    opened.push(*o)
            by_tag = tag in SKIPPED_TAGS and not (content and not opened.content)
            by_name = not by_tag and not (content and not opened.content) and _named(tag, attributes)
            numbers += by_name
            if tag in CONTAINERS or by_name:
                opened.push(tag, by_tag, numbers if by_name else 0, content)
    close()
    return out


def _freed(blocks: list[Block]) -> None:
    """Marks what is skipped by name; but if that leaves no long prose, the outermost such container that holds most of it is no longer skipped."""
    if not any(b.named for b in blocks):
        return
    prose = [b for b in blocks if not b.skipped and len(b.text) > LONG and b.density <= LINKS and b.stops >= STOPS]
    free: set[int] = set()
    while prose and all(set(b.named) - free for b in prose):
        held: dict[int, int] = {}
        for b in prose:
            first = next(k for k in b.named if k not in free)
            held[first] = held.get(first, 0) + len(b.text)
        free.add(max(held, key=lambda k: (held[k], -k)))
    for b in blocks:
        b.skipped = b.skipped or bool(set(b.named) - free)


def _decide(block: Block, articles: bool) -> bool | None:
    """First pass: True for content, False for boilerplate, None for undecided."""
    if block.skipped:
        return False
    size = len(block.text)
    if block.density > LINKS:
        return False
    if block.part:
        return True if size >= SHORT else None
    if articles or block.heading or size < SHORT:
        return None
    stops = block.stops
    return True if stops >= STOPS and size > LONG else None if stops >= STOPS / 2 or size > LONG else False


def main_text(html: str) -> str:
    """Content blocks of a page in order, joined by one line feed; empty if there are none."""
    blocks = blocks_of(html)
    _freed(blocks)
    articles = any(b.part for b in blocks)
    labels = [_decide(b, articles) for b in blocks]
    decided = [(k, b.part, labels[k]) for k, b in enumerate(blocks) if labels[k] is not None and not b.skipped]
    out, at = [], 0
    for k, block in enumerate(blocks):
        while at < len(decided) and decided[at][0] < k:
            at += 1
        label = labels[k]
        if label is None:
            sides = [d for d in (decided[at - 1] if at else None, decided[at] if at < len(decided) else None) if d and d[1] == block.part]
            if block.part:  # in an article, only what stands between boilerplate goes
                label = len(sides) < 2 or any(d[2] for d in sides)
            elif articles:
                label = False
            else:
                label = min((abs(d[0] - k), not d[2]) for d in sides)[1] is False if sides else True
        if label:
            out.append(block.text)
    return "\n".join(out)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text (never null) and n_chars, its code points. A null page is empty, and so is one without content.

    A page of any length is read as a whole, in a time that grows with its length, whatever is left open in it. Repeated rows give the same text; of equally near decided neighbours
    content counts; an empty table gives an empty table; existing columns of the new names are replaced, others stay as they are.
    """
    pages = pages.drop("text", "n_chars")

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(h) if h else "" for at in range(0, len(column), 64) for h in column.slice(at, 64).to_pylist()], pa.string())

    return pages.withColumn("text", text_of(F.col(html).cast("string"))).withColumn("n_chars", F.char_length("text").cast("long"))
