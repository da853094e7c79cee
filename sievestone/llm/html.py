"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks, a block being the text between two block-level tags. Each block
has its word count and link density and those of the blocks before and after it. A decision tree (Gini
impurity, grown here from the small labelled table below) tells main text from the rest. Its first
TEXT_LEVELS splits are by these six features. Only below them may it ask what the open elements say,
since words in attributes mislead and reader comments read like main text: whether the block stands in an
article or main element, in an element that frames a page (navigation, header, footer, sidebar, form), in
one whose class, id or role names an advert, notice or comment section (half, where the name ends in a
word for main text, as in "widget-post"), and whether it is a heading. Attributes of headings are no
hints, nor are ids of sections inside an article, since both are often made from their titles. Scripts,
styles and the head are no text.

Character references are decoded, white space in a block becomes one space, blocks are trimmed, empty
ones vanish, and main blocks are joined in page order by an empty line. Nothing else is dropped and no
length is capped: pages are read whole. Null and empty pages have the empty text, as have pages of
which no block is main text. Broken markup (unclosed or stray tags, a tag or comment cut off by the
end) is read as far as it goes. Rows are judged one by one, so ties and repeated rows have equal
results; an empty table gives an empty result. Other columns are kept; one that has the name of the result is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!?/?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|<[!?][^>]*>|<!?/?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
HINT = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""\s(?:hidden(?=[\s>/=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
WORDY = re.compile(r"\w")

# Elements by what they mean for a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video textarea title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("nav header footer aside form menu dialog select button fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset({"p"})
# Words in a class, id or role that tell what an element is for.
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies respond sidebar side rail widget related recommended share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead toolbar search skip copyright legal disclaimer complementary contentinfo navigation".split())
MAIN_WORDS = frozenset("article content main post entry story body text prose".split())
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
#: As the last word of a name they say that what is named is a piece of main text, of whatever sort.
PIECES = frozenset("article post entry story".split())
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_main", "in_frame", "in_aside", "heading")
#: The first six features are of the text; so many levels of the tree use them alone.
TEXT_FEATURES, TEXT_LEVELS = 6, 2
# The labelled table: blocks as they occur on pages, in the order of FEATURES, then 1 for main text.
LABELLED = """
9 0 5 0 80 0 1 0 0 1 1
80 0 9 0 60 0 1 0 0 0 1
60 0.02 80 0 1 0 1 0 0 0 1
1 0 60 0.02 2 0 1 0 0 0 1
2 0 1 0 40 0 1 0 0 0 1
40 0.1 2 0 12 0 1 0 0 0 1
12 0 40 0.1 14 0 1 0 0 0 1
3 1 12 0 20 0 1 0 0 0 1
1 1 3 0 30 0 1 0 0 0 1
25 0.5 30 0 18 0 1 0 0 0 1
6 0 0 0 0 0 1 0 0 1 1
5 0 6 0 14 0 1 0 0 0 1
1 1 1 1 1 1 0 1 0 0 0
1 1 0 0 1 1 0 1 0 0 0
2 1 1 1 7 0 0 1 0 0 0
14 0 40 0 0 0 0 1 0 0 0
30 0 22 0 0 0 0 1 0 0 0
3 0 0 0 2 1 0 1 0 1 0
12 0.2 60 0 9 0 0 1 0 0 0
45 0 60 0 9 0 0 1 0 0 0
7 0 1 1 9 0 0 0 1 0 0
25 0 1 1 9 0 0 0 1 0 0
40 0.1 70 0 12 0 0 0 1 0 0
4 1 50 0 30 0 0 0 1 0 0
3 0 40 0 25 0 0 0 1 1 0
7 0 50 0 60 0 1 0 1 0 0
35 0 50 0 60 0 1 0 1 0 0
4 0 50 0 40 0 1 0 1 1 0
3 1 50 0 60 0 1 1 0 0 0
20 0 50 0 14 0 1 1 0 0 0
15 0 0 0 50 0 1 1 0 0 0
10 0.3 20 0 0 0 1 1 1 0 0
2 1 7 0 9 0 0 1 1 0 0
12 0 7 0 9 0 0 1 1 0 0
8 0 1 1 45 0 0 0 0 1 1
5 0 2 1 70 0.05 0 0 0 1 1
45 0 8 0 60 0 0 0 0 0 1
70 0.05 5 0 30 0 0 0 0 0 1
30 0 70 0.05 20 0.1 0 0 0 0 1
22 0.1 45 0 50 0 0 0 0 0 1
16 0 50 0 35 0 0 0 0 0 1
18 0 25 0 4 1 0 0 0 0 1
6 0 60 0 50 0 0 0 0 0 1
3 0 45 0 33 0 0 0 0 0 1
1 1 2 1 1 1 0 0 0 0 0
2 1 1 1 2 1 0 0 0 0 0
3 1 3 1 1 1 0 0 0 0 0
5 1 2 1 8 0 0 0 0 0 0
7 0.9 20 0 6 1 0 0 0 0 0
12 0.8 40 0 6 1 0 0 0 0 0
4 0 1 1 2 1 0 0 0 0 0
3 0 2 1 3 0.5 0 0 0 0 0
6 0 3 1 0 0 0 0 0 0 0
5 0.6 4 1 3 1 0 0 0 0 0
7 0 60 0 5 0 1 0 1 0 0
25 0 90 0 6 0 1 0 1 0 0
60 0 70 0 3 0 1 0 1 0 0
40 0 12 0 8 0 1 0 1 0 0
18 0 1 1 4 0 0 0 1 0 0
50 0 30 0 20 0 0 0 1 0 0
90 0 60 0 70 0 0 0 1 0 0
2 0 9 0 2 0 0 0 1 0 0
9 0.3 5 0 6 0 1 0 1 0 0
30 0 30 0 30 0 1 0 1 0 0
30 0 30 0 30 0 0 0 1 0 0
12 0 4 0 60 0 1 0 1 0 0
80 0 4 0 9 0 1 0 1 0 0
1 0 80 0 0 0 1 0 1 0 0
2 1 5 1 2 1 1 1 0 0 0
40 0 5 0 30 0 1 1 0 0 0
30 0 80 0 2 0 1 1 0 0 0
5 0 60 0 4 0 1 1 0 0 0
55 0 20 0 40 0 0 1 0 0 0
25 0 9 0 45 0 0 1 0 0 0
4 0 70 0 60 0 0 1 0 0 0
60 0 5 1 60 0 0 1 0 0 0
9 0 3 1 50 0 0 1 0 1 0
4 0.5 80 0 6 0 1 0 0 0 1
1 1 90 0 0 0 1 0 0 0 1
2 1 2 1 2 1 1 0 0 0 1
9 0.9 40 0 3 1 1 0 0 0 1
1 0 2 1 1 0 1 0 0 0 1
3 0 2 1 4 0 1 0 0 0 1
55 0.3 2 1 6 0 1 0 0 0 1
20 0 0 0 0 0 1 0 0 0 1
1 0 1 1 1 1 1 0 0 1 1
4 1 3 1 70 0 1 0 0 1 1
6 0.6 7 0 8 0 1 0 0 0 1
20 0 3 1 0 0 1 0 0 0 1
1 0 1 1 0 0 1 0 0 0 1
9 1 5 1 0 0 1 0 0 0 1
5 1 3 1 60 0 1 0 0 0 1
12 1 4 1 30 0 1 0 0 0 1
2 0.9 9 0.8 1 0 1 0 0 0 1
40 0 9 0.8 2 0 1 0 0 1 1
1 1 1 1 35 0 0 0 0 0 0
2 1 2 1 60 0 0 0 0 0 0
3 1 0 0 50 0 0 0 0 0 0
1 1 1 1 90 0.1 0 0 0 0 0
4 0.9 30 0 40 0 0 0 0 0 0
35 0 1 1 0 0 0 0 0 0 1
60 0 2 1 0 0 0 0 0 0 1
40 0.05 1 1 1 1 0 0 0 0 1
80 0 3 1 2 1 0 0 0 0 1
45 0 0 0 0 0 0 0 0 0 1
60 0 0 0 0 0 0 0 0.5 0 1
60 0.05 12 0 40 0 0 0 0.5 0 1
35 0 60 0 5 0 1 0 0.5 0 1
28 0.1 30 0 25 0 1 0 0.5 0 1
4 0 1 1 9 0 0 0 0.5 0 0
9 0.5 7 0.9 8 0.8 0 0 0.5 0 0
8 1 9 0.5 9 0.5 1 0 0.5 0 0
3 1 50 0 2 1 1 0 0.5 0 0
9 0 8 0.5 7 0.6 0 0 0.5 0 0
30 0 5 1 60 0 0 1 0.5 0 0
"""


# What the rest of the table runs over: words and link densities of a block, neighbours as
# (words, link density) before and after, and contexts as in_main, in_frame, in_aside, heading.
SIZES, DENSITIES = (1, 2, 4, 8, 15, 30, 60), (0, 0.1, 0.5, 1)
AROUND = ((0, 0, 40, 0), (40, 0, 2, 1), (2, 1, 6, 0), (6, 0, 0, 0), (40, 0, 40, 0), (2, 1, 2, 1))
CONTEXTS = ((1, 0, 0, 0), (1, 0, 0, 1), (0, 1, 0, 0), (1, 1, 0, 0), (0, 0, 1, 0), (1, 0, 1, 0), (0, 0, 0.5, 0), (0, 0, 0, 0), (0, 0, 0, 1))


def label(row: tuple[float, ...]) -> int:
    """What blocks are by rule: of an article, all that is in no frame and not aside; elsewhere, text of some length outside links, or near longer text."""
    words, density, before, density_before, after, density_after, main, frame, aside, heading = row
    if frame or aside == 1:
        return 0
    if main:
        return 1
    plain = words * (1 - density)
    if aside:
        return int(plain >= 20)
    near = max(before * (1 - density_before), after * (1 - density_after))
    return int(plain >= 12 or density <= 0.2 and near >= 30 and (plain >= 3 or bool(heading)))


def samples() -> list[tuple[tuple[float, ...], int]]:
    """The labelled table: the rows above, and three for each size, density and context, the neighbours taking turns."""
    rows = [tuple(float(x) for x in line.split()) for line in LABELLED.strip().splitlines()]
    out = [(r[:-1], int(r[-1])) for r in rows]
    made = [(w, d, *AROUND[(k + i + j + 2 * t) % len(AROUND)], *c) for t in range(3) for k, c in enumerate(CONTEXTS) for i, w in enumerate(SIZES) for j, d in enumerate(DENSITIES)]
    return out + [(r, label(r)) for r in made]


def grow(rows: list[tuple[tuple[float, ...], int]], least: int = 3, depth: int = 0) -> tuple | float:
    """A binary tree: (feature, bound, at most the bound, above it), or the share of main text at a leaf."""
    share = sum(y for _, y in rows) / len(rows)
    if share in (0, 1) or len(rows) < 2 * least:
        return share
    gini = lambda part: 2 * (q := sum(y for _, y in part) / len(part)) * (1 - q) * len(part)
    best = None
    for f in range(TEXT_FEATURES if depth < TEXT_LEVELS else len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:], strict=False):
            bound = (low + high) / 2
            parts = [r for r in rows if r[0][f] <= bound], [r for r in rows if r[0][f] > bound]
            cost = gini(parts[0]) + gini(parts[1])
            if min(map(len, parts)) >= least and (best is None or cost < best[0] - 1e-12):
                best = cost, f, bound, parts
    if best is None:
        return share
    return best[1], best[2], grow(best[3][0], least, depth + 1), grow(best[3][1], least, depth + 1)


@cache
def tree() -> tuple | float:
    return grow(samples())


def is_main(features: tuple[float, ...]) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node > 0.5


def hints(tag: str, name: str, in_main: bool) -> tuple[float, bool]:
    """What the names in a tag say: 1 for something aside, a half for a piece of main text that stands aside, and whether it is main text."""
    aside, main = 0.0, False
    for m in HINT.finditer(tag):
        if m[1].lower() == "id" and name == "section" and in_main:
            continue
        for named in (m[2] or m[3] or m[4] or "").split():
            words = [w.lower() for w in SPLIT.split(named) if w]
            lowered = set(words) | {w for w in SPLIT.split(named.lower()) if w}
            if lowered & ASIDE_WORDS:
                aside = max(aside, 0.5 if words[-1] in PIECES and not lowered & COMMENT_WORDS else 1.0)
            elif lowered & MAIN_WORDS:
                main = True
    return aside, main and aside == 0


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, float, bool]]:
    """(text, words, link density, in main, in frame, in aside, heading) of each block that has text."""
    out: list[tuple[str, int, float, bool, bool, float, bool]] = []
    stack: list[tuple[str, bool, bool, bool, float, bool]] = []  # name, silent, main, frame, aside, heading
    open_: Counter[str] = Counter()  # names in the stack
    pieces: list[tuple[str, bool]] = []
    links = 0

    def state() -> tuple[bool, bool, bool, float, bool]:
        return stack[-1][1:] if stack else (False, False, False, 0.0, False)

    def leave() -> str:
        gone = stack.pop()[0]
        open_[gone] -= 1
        return gone

    def flush() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                words = sum(bool(WORDY.search(w)) for w in text.split())
                linked = sum(len(p.split()) for p, a in pieces if a)
                _, main, frame, aside, heading = state()
                out.append((text, words, min(1.0, linked / max(1, len(text.split()))), main, frame, aside, heading))
            pieces.clear()

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not state()[0]:
            pieces.append((html.unescape(text), links > 0))
        if not m:
            break
        at, tag = m.end(), m[0]
        named = NAME.match(tag)
        if not named:
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if name in BLOCKS:
                flush()
            if open_[name]:
                while stack:
                    gone = leave()
                    links -= gone == "a"
                    if gone == name:
                        break
            continue
        if name in BLOCKS:
            flush()
            if stack and stack[-1][0] in CLOSED_BY_BLOCK or name in ("li", "p") and any(s[0] == name == "p" for s in stack[-4:]):
                while stack and stack[-1][0] != "p":
                    if stack[-1][0] in BLOCKS:
                        break
                    links -= leave() == "a"
                if stack and stack[-1][0] == "p":
                    leave()
        elif name == "br":
            pieces.append((" ", links > 0))
        if name in VOID or tag.endswith("/>") and name not in BLOCKS and name != "a":
            continue
        silent, main, frame, aside, heading = state()
        outer = name in ("html", "body")
        off, on = hints(tag, name, main) if "=" in tag and name not in HEADINGS else (0.0, False)
        if name in MAIN or on and name in BLOCKS:
            main = True
        if name in FRAME:
            frame = True
        if not outer and name not in MAIN:
            aside = max(aside, off)
        silent = silent or name in SILENT or name == "head" or bool(HIDDEN.search(tag)) and not outer
        stack.append((name, silent, main, frame, aside, heading or name in HEADINGS))
        open_[name] += 1
        links += name == "a"
        if name == "body":  # a head that was never closed ends here
            stack[:] = [s for s in stack if s[0] in ("html", "body")]
            stack[-1] = ("body", False, False, False, 0.0, False)
            open_, links = Counter(s[0] for s in stack), 0
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            leave()
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    edge = ("", 0, 0.0, False, False, 0.0, False)
    kept = []
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else edge, found[k + 1] if k + 1 < len(found) else edge
        if is_main((b[1], b[2], before[1], before[2], after[1], after[2], *map(float, b[3:]))):
            kept.append(b[0])
    return "\n\n".join(kept)


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with their main text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    return pages.withColumn(text_col, text(F.col(html_col)))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

