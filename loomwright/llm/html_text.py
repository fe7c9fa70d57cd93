"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block. A line weighs as much as it has text outside links, and nothing where
its markup says that it is menu, notice, advert and the like; such lines are taken out first. Sums over a sliding window
of the other lines show where text surges and where it dives: the first and last long lines in windows of at least SURGE
characters bound the text. What lies between stays, and so do the shorter lines that adjoin, as long as they are in the
block that holds all long lines. If the best window lies in an element marked as the article, lines outside such elements
weigh nothing, and those inside weigh as much as they have text.

Defined results: a null or empty page, and one without text, give the empty text; a page without a surge gives all lines
that have weight; unclosed and stray tags are allowed; a page whose text is in one form, or all marked by class words as no
article text, is read without these marks. Pages of any length are read whole, in time linear in their length; repeated
rows are answered each; further columns are those named in `keep`.
"""

from __future__ import annotations

import html
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts_of

WINDOW = 3
#: Characters in a window from which on text surges, and of a line that can begin or end it.
SURGE, LONG = 150, 50

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>?|<[!?][^>]*>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Their content is no text of the page.
RAW = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in ("script", "style", "title", "noscript", "template", "svg", "iframe", "textarea", "object", "canvas", "audio", "video", "math")}
NOISE_TAGS = frozenset("nav aside footer button select dialog menu head form".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin login comment comments commentlist disqus respond reply replies discussion "
    "share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright disclaimer masthead topbar skip offcanvas".split()
)
#: Words that say of noise where or what it is.
PLACE_WORDS = frozenset(
    "area articles bar block blocks bottom box button buttons col column container content fb form google icon icons inline inner item items left link links list main mobile news outer panel post posts row section "
    "side slot small stories story strip tools top twitter unit us wrap wrapper zone right center middle in by the a for js el wp js v1 v2 1 2 3 4 5".split()
)
HEADER_WORDS = frozenset(("header", "head", "top"))
#: Ids that mark no article text even inside an article; other ids there may be a heading's anchor.
NOISE_IDS = frozenset("comments comment-list commentlist disqus disqus_thread respond sidebar footer newsletter".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold lines; others are lines themselves.
CONTAINERS = frozenset("html body div section article main aside header footer nav form table tbody thead tfoot tr td th blockquote center details fieldset ul ol dl".split())
ARTICLE_ROLES = frozenset(("main", "article"))
ARTICLE_NAMES = re.compile(r"\b(?:article|post|entry|story|main|page)[-_]?(?:body|content|text)\b|\barticlebody\b", re.I)


@dataclass
class Line:
    text: str
    noise: bool
    article: bool
    links: int
    #: The number of the block that holds the line.
    holder: int


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)}


def _words(value: str) -> set[str]:
    return {w.lower() for w in WORD.findall(value)}


def _noise_name(name: str) -> bool:
    """Whether a class says by all its words that an element is no text; a subject such as "social-impact" doesn't."""
    found = _words(name)
    return bool(found & NOISE_WORDS) and found <= NOISE_WORDS | PLACE_WORDS


def _noisy(name: str, raw: str, inside: bool, forms: bool, words: bool) -> bool:
    """Whether an element holds no article text; forms: forms do not; words: class words and ids tell."""
    if name in ("html", "body", "article", "main"):
        return False
    if name in NOISE_TAGS and (name != "form" or forms):
        return True
    if name == "header" and not inside:
        return True
    if not raw.strip():
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    role = a.get("role", "")
    if role in NOISE_ROLES and (role != "form" or forms):
        return True
    if not words or name in HEADINGS:
        return False
    if inside:
        return any(map(_noise_name, a.get("class", "").split())) or a.get("id", "").lower() in NOISE_IDS
    found = _words(f"{a.get('class', '')} {a.get('id', '')}")
    return bool(found & NOISE_WORDS or found & HEADER_WORDS and name in ("div", "section", "table", "ul"))


def _is_article(name: str, raw: str) -> bool:
    if name in ("article", "main"):
        return True
    if not raw.strip():
        return False
    a = _attributes(raw)
    return a.get("role") in ARTICLE_ROLES or bool(ARTICLE_NAMES.search(f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')}"))


class _Reader:
    """Lines of a page as its tags come. A stack entry: name, noise, article, holder, and for noise inside a line where its
    text begins among the parts (else None)."""

    def __init__(self, forms: bool, words: bool):
        self.forms, self.words = forms, words
        self.lines: list[Line] = []
        self.holders: list[int] = [0]
        self.stories: set[int] = set()  # blocks that are elements of a whole story
        self.parts: list[str] = []
        self.stack: list[list] = []
        self.open: Counter[str] = Counter()
        self.inline: list[list] = []  # noise inside a line that is still open
        self.links, self.in_link = 0, False

    def text(self, value: str) -> None:
        self.parts.append(value)
        if self.in_link:
            self.links += len(value.strip())

    def line(self) -> None:
        if self.parts:
            if self.inline:  # noise that is still open goes from this line, and from where the next one begins
                del self.parts[self.inline[0][4] :]
                for x in self.inline:
                    x[4] = 0
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                _, noise, article, holder, _ = next((x for x in reversed(self.stack) if x[4] is None), ("", False, False, 0, None))
                self.lines.append(Line(text, noise, article, self.links, holder))
            self.parts.clear()
        self.links = 0

    def _close(self, i: int) -> None:
        """Ends the entries of the stack from i on."""
        marks = [x[4] for x in self.stack[i:] if x[4] is not None]
        if marks:
            del self.parts[marks[0] :]
            del self.inline[-len(marks) :]
        self.open.subtract(x[0] for x in self.stack[i:])
        del self.stack[i:]

    def end(self, name: str) -> None:
        if self.open[name] > 0:
            self._close(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name))

    def begin(self, name: str, raw: str) -> None:
        if name in BLOCK:  # a block ends an open paragraph
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p" or name == "li" and self.stack[i][0] == "li":
                    self._close(i)
                    break
                if self.stack[i][0] in BLOCK:
                    break
        above = self.stack[-1] if self.stack else ["", False, False, 0, None]
        noise = above[1] or _noisy(name, raw, above[2], self.forms, self.words)
        if name in BLOCK:
            holder = above[3]
            if name in CONTAINERS:
                self.holders.append(holder)
                holder = len(self.holders) - 1
                if name in ("article", "main"):
                    self.stories.add(holder)
            self.stack.append([name, noise, not noise and (above[2] or _is_article(name, raw)), holder, None])
        elif noise and not above[1]:
            self.stack.append([name, True, False, above[3], len(self.parts)])
            self.inline.append(self.stack[-1])
        else:
            return
        self.open[name] += 1


def lines_of(page: str, forms: bool = True, words: bool = True) -> tuple[list[Line], list[int], set[int]]:
    """The page's lines in order, for each block the block that holds it, and the blocks of stories."""
    out, at, n = _Reader(forms, words), 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            out.text(page[at:])
            break
        if m.start() > at:
            out.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closes = m[2].lower(), bool(m[1])
        if name in BLOCK:
            out.line()
        elif name == "br":
            out.parts.append(" ")
        if name == "a":
            out.in_link = not closes
        if name in RAW:
            if not closes and not m[3].endswith("/"):
                end = RAW[name].search(page, at)
                at = end.end() if end else n
        elif closes:
            out.end(name)
        elif name not in VOID and not m[3].endswith("/"):
            out.begin(name, m[3])
    out.line()
    return out.lines, out.holders, out.stories


def window_sums(weights: list[int]) -> list[int]:
    """What weigh WINDOW lines from each one on."""
    total = [0, *accumulate(weights)]
    return [total[min(i + WINDOW, len(weights))] - total[i] for i in range(len(weights))]


def _common(holders: list[int], blocks: set[int]) -> int:
    """The innermost block that holds all of some blocks; a block's number is above its holder's."""
    left = sorted(blocks)
    while len(left) > 1:
        insort(left, holders[left.pop()])
        if len(left) > 1 and left[-1] == left[-2]:
            left.pop()
    return left[0]


def _within(holders: list[int], outer: set[int]) -> list[bool]:
    """For each block, whether it is one of some blocks or in one. One pass, as a block's number is above its holder's."""
    inside = [0 in outer]
    for block in range(1, len(holders)):
        inside.append(block in outer or inside[holders[block]])
    return inside


def bounds(live: list[Line], weights: list[int], holders: list[int]) -> tuple[int, int]:
    """The first line of the text and the one after its last: from where it surges to where it dives, with what adjoins."""
    sums = window_sums(weights)
    # a line is in a surge if one of the windows that hold it is
    core = [i for i, w in enumerate(weights) if w >= LONG and max(sums[max(0, i - WINDOW + 1) : i + 1]) >= SURGE]
    if not core:
        return 0, len(live)
    begin, end = core[0], core[-1] + 1
    inside = _within(holders, {_common(holders, {live[i].holder for i in core})})
    adjoins = lambda i: weights[i] > 0 and inside[live[i].holder]
    while begin > 0 and adjoins(begin - 1):
        begin -= 1
    while end < len(live) and adjoins(end):
        end += 1
    return begin, end


def own_story(live: list[Line], holders: list[int], stories: set[int]) -> list[Line]:
    """The lines without other stories (teasers) inside a story: those that weigh less than what is the outer one's own."""

    story = [0]  # of each block, the innermost one that it is or is in
    for block in range(1, len(holders)):
        story.append(block if block in stories else story[holders[block]])
    own: Counter[int] = Counter()
    for x in live:
        own[story[x.holder]] += max(len(x.text) - x.links, 0)
    whole = Counter(own)
    for s in sorted(stories, reverse=True):  # a block's number is above its holder's
        whole[story[holders[s]]] += whole[s] if holders[s] else 0
    most: Counter[int] = Counter()
    for s in stories:
        outer = story[holders[s]]
        most[outer] = max(most[outer], whole[s])
    other = {s for s in stories if story[holders[s]] and own[story[holders[s]]] > most[story[holders[s]]]}

    inside = _within(holders, other)
    return [x for x in live if not inside[x.holder]] if other else live


def main_text(page: str | None) -> str:
    if not page:
        return ""
    live, holders, stories, most = [], [], set(), 0
    for forms, words in ((True, True), (False, True), (True, False), (False, False)):
        # class words are doubted only where they leave nothing, forms also where text surges in one and nowhere else
        if most >= SURGE or live and not words:
            break
        found, blocks, whole = lines_of(page, forms, words)
        kept = [x for x in found if not x.noise]
        now = max(window_sums([len(x.text) for x in kept]), default=0)
        if now and not live or now >= SURGE:
            live, holders, stories, most = kept, blocks, whole, now
    live = own_story(live, holders, stories)
    weights = [max(len(x.text) - x.links, 0) for x in live]
    begin, end = bounds(live, weights, holders)
    return "\n".join(x.text for x in live[begin:end])


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns named in keep, text, n_chars (code points)."""
    cols = (key, *keep)
    src = pages.select(*cols, F.col(page).alias("page"))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in cols) + ", text string"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = [main_text(x) for x in texts_of(batch.column(len(cols)))]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(text, pa.string())], [*cols, "text"])

    return map_arrow(src, run, schema, by="page").withColumn("n_chars", F.length("text").cast("long"))
