"""Main text of web pages: a minimum cut labels each block of a page as content or boilerplate."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from kermesse.llm.common import slices

# The elements of HTML by what they do to text.
SKIPPED = frozenset("title script style noscript template svg math iframe object select textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog button".split())
CONTENT = frozenset("article main".split())
CLOSED_BY_BLOCK = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that tell what an element is.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs "
    "byline comment comments consent cookie cookies copyright disclaimer disqus feedback footer "
    "footnav gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pagination pager popup promo promoted promotion related reply replies "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser "
    "toolbar topbar widget".split()
)
CONTENT_NAMES = frozenset("article content entry main post story body".split())
# A name with one of these tells of a page that has furniture, not of furniture: "has-sidebar",
# "content-sidebar-wrap".
LAYOUT_NAMES = frozenset("container has layout no with without wrap wrapper".split())
# Furniture that may hold a page's longest article all the same.
READERS_NAMES = frozenset("comment comments disqus feedback related replies reply respond".split())
# Elements that end those of SKIPPED left open before them.
PAGE_STARTS = frozenset("article body main".split())

SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Za-z]+")

# Weights of the classifier and of the two kinds of smoothness.
BIAS, IN_FURNITURE, NAMED_FURNITURE, IN_CONTENT, NAMED_CONTENT = -0.5, -9.0, -9.0, 5.0, 3.0
PER_WORD, MOST_WORDS, FULL_STOP, LINKED, HEADING, PAGE_HEADER = 0.04, 60, 0.6, -4.0, 0.3, -6.0
ADJACENT, NEAR = 0.5, 0.8


class Element:
    """An element with what it is itself; `settle` adds what holds for all that lies in it. Elements
    know those around them by one link each, so deep pages take no more memory than flat ones."""

    __slots__ = (
        "tag", "around", "box", "depth", "link", "furniture", "named", "readers", "content",
        "named_content", "header", "words", "article",
    )

    def __init__(self, tag: str, around: Element | None = None, names: frozenset[str] | set[str] = frozenset()):
        self.tag, self.around = tag, around
        # The next element around it that is a box, which inline ones are not.
        self.box = around and (around if around.tag not in INLINE else around.box)
        self.depth = 0 if around is None else self.box.depth + 1
        self.link = tag == "a" or bool(around and around.link)
        self.furniture = tag in FURNITURE
        self.named = bool(names & FURNITURE_NAMES) and tag not in ("body", "html")
        self.readers = self.named and bool(names & READERS_NAMES)
        self.content = tag in CONTENT
        self.named_content = bool(names & CONTENT_NAMES)
        self.header = tag == "header"
        self.words = 0  # in all that lies in it
        self.article = 0  # in the longest article in it


@dataclass
class Block:
    """A run of text between two block borders, and the element it lies in."""

    home: Element
    text: str
    linked: int
    total: int


def names_of(attrs) -> set[str]:
    """Words of class, id and role; of a name that tells of the layout, only those of content."""
    found = set()
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.split():
                words = {word.lower() for word in NAME.findall(name)}
                found |= words - FURNITURE_NAMES if words & LAYOUT_NAMES else words
    return found


class Blocks(HTMLParser):
    """Cuts a page into blocks. Unclosed elements end with the element around them.

    Each step looks at the open elements that it ends and no others, so a page is read in time in
    proportion to its length, however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Element("#")]
        self.made = list(self.stack)
        self.open_at: dict[str, list[int]] = {}  # places in the stack, by tag
        self.boxes = [0]  # places of elements that are not inline
        self.skipped = 0
        self.blocks: list[Block] = []
        self.pieces: list[tuple[str, bool]] = []

    def border(self) -> None:
        """Ends the block that is being read."""
        text = "".join(piece for piece, _ in self.pieces)
        if words := SPACE.sub(" ", text).strip():
            linked = sum(len(piece) for piece, link in self.pieces if link)
            home = self.stack[self.boxes[-1]]
            home.words += words.count(" ") + 1
            self.blocks.append(Block(home, words, linked, max(1, len(text))))
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        if tag in PAGE_STARTS and self.skipped:
            first = min(self.open_at[t][0] for t in SKIPPED if self.open_at.get(t))
            self._cut(first)
        if tag not in INLINE:
            self.border()
        if tag in VOID:
            return
        if tag in CLOSED_BY_BLOCK:
            self._close_open("p")
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            self._close_open(tag)
        if tag in SKIPPED:
            self.skipped += 1
        place = len(self.stack)
        self.stack.append(Element(tag, self.stack[-1], names_of(attrs)))
        self.made.append(self.stack[-1])
        self.open_at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.boxes.append(place)

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.border()

    def _cut(self, place: int) -> None:
        """Ends the elements from a place of the stack on."""
        for element in reversed(self.stack[place:]):
            self.open_at[element.tag].pop()
            self.skipped -= element.tag in SKIPPED
        del self.stack[place:]
        while self.boxes[-1] >= place:
            self.boxes.pop()

    def _close_open(self, tag):
        """An element that the next one ends without an end tag, if it is open in the same box."""
        places = self.open_at.get(tag)
        if places and places[-1] == self.boxes[-1]:
            self._cut(places[-1])

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.border()
        places = self.open_at.get(tag)
        # A stray end tag of an inline element closes nothing beyond its box.
        if places and (tag not in INLINE or places[-1] > self.boxes[-1]):
            self._cut(places[-1])

    def handle_data(self, data):
        if not self.skipped:
            self.pieces.append((data, self.stack[-1].link))


def settle(made: list[Element]) -> None:
    """Hand on what elements are to all that lies in them.

    What holds half of a page's words in one article or main element is no furniture, whatever it
    is called - unless it is the readers' part.
    """
    for element in reversed(made[1:]):
        around = element.around
        around.words += element.words
        own = element.words if element.content else 0
        element.article = max(element.article, own)
        around.article = max(around.article, element.article)
    half = made[0].words / 2
    for element in made[1:]:
        around = element.around
        if 0 < half <= element.article and not element.content and not element.readers:
            element.furniture = element.named = False
        element.header = around.header or (element.header and not around.content)
        element.furniture |= around.furniture
        element.named |= around.named
        element.content |= around.content
        element.named_content |= around.named_content


def blocks_of(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.border()
    settle(parser.made)
    return parser.blocks


def content_odds(block: Block) -> float:
    """The classifier: log odds that a block is content."""
    home, text = block.home, block.text
    score = BIAS + PER_WORD * min(MOST_WORDS, text.count(" ") + 1)
    score += IN_FURNITURE * home.furniture + NAMED_FURNITURE * home.named
    score += IN_CONTENT * home.content + NAMED_CONTENT * home.named_content
    score += PAGE_HEADER * home.header + HEADING * (home.tag in HEADINGS)
    score += FULL_STOP * (text[-1] in ".!?…") + LINKED * min(1.0, block.linked / block.total)
    return score


def steps_between(a: Element, b: Element) -> int:
    """Boxes to leave and to enter on the way from one to the other. Of neighbours on a page these
    are the ones that end and begin between them, so all steps of a page are as many as its boxes."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.box
        else:
            b = b.box
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours on the page, the weaker the more elements lie between them, and
    blocks that follow one another within one element."""
    edges = []
    last_in: dict[Element, int] = {}
    for i, block in enumerate(blocks):
        if i:
            steps = steps_between(blocks[i - 1].home, block.home)
            edges.append((i - 1, i, ADJACENT / (1 + steps)))
        around = block.home.box or block.home
        if around in last_in:
            edges.append((last_in[around], i, NEAR))
        last_in[around] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each block is on the content side of the minimum cut.

    Costs are -log of the classifier's probabilities, from the source for content and to the sink
    for boilerplate; what both share flows at once. Then flow is pushed along shortest paths, level
    by level, until no path is left; what the source still reaches is content.
    """
    n = len(odds)
    source, sink = n, n + 1
    # log(1 + e^x) - log(1 + e^-x) = x: beyond the common part, the odds are all that is left.
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forward: float, backward: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forward)
        heads[b].append(len(to))
        to.append(a)
        room.append(backward)

    for i, x in enumerate(odds):
        if x > 0:
            link(source, i, x, 0.0)
        elif x < 0:
            link(i, sink, -x, 0.0)
    for a, b, weight in edges:
        link(a, b, weight, weight)

    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            at = queue.popleft()
            for e in heads[at]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[at] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                pushed = min(room[e] for e in path)
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                first = next(i for i, e in enumerate(path) if room[e] <= least)
                at = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[at] < len(heads[at]):
                e = heads[at][turn[at]]
                if room[e] > least and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(heads[at]):
                path.append(heads[at][turn[at]])
                at = to[path[-1]]
            elif path:
                at = to[path.pop() ^ 1]
                turn[at] += 1
            else:
                break


def main_text(html: str | None) -> str:
    """The content blocks in page order, joined by one space; empty if there is none."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    kept = minimum_cut([content_odds(b) for b in blocks], edges_of(blocks))
    return " ".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` without its html, with `text`, the main text, and `n_chars`, its code points.

    Columns called text or n_chars are replaced. Null and empty pages have an empty text. Rows
    never meet; a page is cut within its task, in time and memory that follow the page, however deep
    its elements lie.
    """
    out = StructType.fromDDL("text string, n_chars long")
    rest = pages.drop(html, *out.names)
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                texts = [main_text(page) for page in part.column(html).to_pylist()]
                kept = part.select(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept.columns,
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=[*names, *out.names],
                )

    return pages.mapInArrow(run, StructType([*rest.schema.fields, *out.fields]))
