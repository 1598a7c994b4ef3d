"""Main text of HTML pages, from flat text blocks and a decision tree.

A page is cut into blocks of text at block-level tags; scripts, styles, comments and the like are
skipped. A block is described by its own word count and link density, those of the blocks before and
after it, and by what encloses it. A decision tree fitted on the labelled blocks below decides which
blocks belong to the main text, from all of these also on pages that mark their article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from parcelry.llm.common import slices
from parcelry.llm.trees import nested

FEATURES = (
    "words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density",
    "side", "main",
)

# Labelled blocks: words and link density of the block, of the one before and the one after; whether
# something that is not content encloses it (side: navigation, notice, advert, form, comments and the
# like, by tag, class, id or role; 1 yes, 0.5 if only a part of a class or id says so, or an article
# starts inside of such a mark); whether an article or main element does (main: 1 yes, 0 no, -1
# the page has no such element); and whether it is main text.
LABELLED = (
    # articles: headings, long and short paragraphs, lists, quotes and link lines
    (8, 0.0, 6, 0.0, 60, 0.0, 0, 1, 1), (60, 0.0, 8, 0.0, 45, 0.02, 0, 1, 1), (45, 0.02, 60, 0.0, 4, 0.0, 0, 1, 1),
    (4, 0.0, 45, 0.02, 80, 0.0, 0, 1, 1), (1, 0.0, 80, 0.0, 30, 0.0, 0, 1, 1), (2, 0.0, 1, 0.0, 12, 0.0, 0, 1, 1),
    (12, 0.5, 30, 0.0, 25, 0.0, 0, 1, 1), (3, 1.0, 20, 0.0, 22, 0.0, 0, 1, 1), (150, 0.01, 5, 0.0, 9, 1.0, 0, 1, 1),
    (25, 0.1, 3, 1.0, 7, 0.0, 0, 1, 1), (7, 0.0, 25, 0.1, 9, 0.0, 0, 1, 1), (300, 0.0, 10, 0.0, 0, 0.0, 0, 1, 1),
    (6, 0.0, 1, 1.0, 5, 0.0, 0, 1, 1), (5, 0.0, 6, 0.0, 14, 0.0, 0, 1, 1), (10, 0.2, 10, 0.2, 10, 0.2, 0, 1, 1),
    (18, 0.0, 9, 0.0, 8, 0.1, 0, 1, 1), (2, 1.0, 40, 0.0, 35, 0.05, 0, 1, 1), (90, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    # the same kinds of block inside something that is not content
    (6, 1.0, 5, 1.0, 6, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0),
    (12, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0), (30, 0.0, 4, 0.0, 60, 0.0, 1, 0, 0), (9, 0.2, 150, 0.0, 0, 0.0, 1, 0, 0),
    (25, 0.1, 2, 1.0, 30, 0.0, 1, 1, 0), (60, 0.0, 8, 0.0, 70, 0.0, 1, 1, 0), (3, 0.0, 60, 0.0, 2, 0.0, 1, 1, 0),
    (5, 0.0, 20, 0.0, 40, 0.0, 1, 1, 0), (14, 0.0, 30, 0.0, 3, 1.0, 1, 1, 0), (110, 0.0, 90, 0.0, 80, 0.0, 1, 1, 0),
    (40, 0.0, 6, 0.0, 55, 0.0, 1, -1, 0), (4, 1.0, 4, 1.0, 4, 1.0, 1, -1, 0), (70, 0.0, 60, 0.0, 8, 0.0, 1, -1, 0),
    (8, 0.0, 2, 1.0, 1, 1.0, 1, -1, 0), (16, 0.0, 0, 0.0, 12, 0.0, 1, 0, 0), (200, 0.0, 7, 0.0, 9, 0.0, 1, 0, 0),
    # outside the article of a page that has one
    (4, 1.0, 3, 1.0, 8, 0.0, 0, 0, 0), (20, 0.0, 5, 1.0, 9, 0.0, 0, 0, 0), (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0),
    (35, 0.0, 90, 0.0, 6, 0.0, 0, 0, 0), (3, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0), (60, 0.3, 40, 0.0, 10, 1.0, 0, 0, 0),
    (12, 0.0, 60, 0.0, 15, 0.0, 0, 0, 0), (1, 0.0, 0, 0.0, 7, 0.0, 0, 0, 0), (90, 0.0, 6, 1.0, 5, 1.0, 0, 0, 0),
    # link-only menus in an article without a mark, and lines that are mostly links beside them
    (3, 1.0, 4, 1.0, 3, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 60, 0.0, 2, 1.0, 0, 1, 0),
    (4, 1.0, 3, 1.0, 45, 0.0, 0, 1, 0), (6, 1.0, 0, 0.0, 5, 1.0, 0, 1, 0), (5, 0.9, 6, 1.0, 8, 1.0, 0, 1, 0),
    (2, 1.0, 2, 1.0, 0, 0.0, 0, 1, 0), (8, 1.0, 7, 1.0, 9, 1.0, 0, 1, 0), (40, 0.0, 3, 1.0, 50, 0.0, 0, 1, 1),
    (55, 0.0, 40, 0.0, 3, 1.0, 0, 1, 1), (5, 0.0, 2, 1.0, 3, 1.0, 0, 1, 1),
    # marked by a part of a name: text and headlines of an article, and links, teasers and labels
    (6, 0.0, 0, 0.0, 60, 0.0, 0.5, 1, 1), (8, 0.0, 2, 1.0, 45, 0.0, 0.5, 1, 1), (60, 0.0, 8, 0.0, 50, 0.0, 0.5, 1, 1),
    (25, 0.0, 60, 0.0, 30, 0.0, 0.5, 1, 1), (90, 0.05, 40, 0.0, 0, 0.0, 0.5, 1, 1), (12, 0.0, 6, 0.0, 30, 0.0, 0.5, 1, 1),
    (3, 1.0, 60, 0.0, 4, 1.0, 0.5, 1, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0.5, 1, 0), (8, 1.0, 2, 0.0, 7, 1.0, 0.5, 1, 0),
    (2, 1.0, 3, 1.0, 40, 0.0, 0.5, 1, 0), (9, 0.8, 50, 0.0, 3, 0.0, 0.5, 1, 0), (3, 1.0, 30, 0.0, 0, 0.0, 0.5, 1, 0),
    (4, 1.0, 3, 1.0, 5, 1.0, 0.5, 0, 0), (12, 0.0, 4, 1.0, 3, 0.0, 0.5, 0, 0), (40, 0.0, 5, 0.0, 6, 1.0, 0.5, 0, 0),
    (6, 0.0, 2, 0.0, 60, 0.0, 0.5, 0, 0), (20, 0.0, 8, 0.0, 90, 0.0, 0.5, 0, 0), (70, 0.0, 8, 0.0, 30, 0.0, 0.5, 0, 0),
    (60, 0.0, 8, 0.0, 45, 0.0, 0.5, -1, 1), (45, 0.0, 60, 0.0, 50, 0.0, 0.5, -1, 1), (120, 0.02, 40, 0.0, 3, 1.0, 0.5, -1, 1),
    (4, 1.0, 3, 1.0, 5, 1.0, 0.5, -1, 0), (3, 0.0, 2, 1.0, 2, 0.0, 0.5, -1, 0), (9, 0.0, 4, 1.0, 3, 1.0, 0.5, -1, 0),
    (2, 1.0, 1, 1.0, 40, 0.0, 0.5, -1, 0), (12, 0.9, 8, 1.0, 6, 1.0, 0.5, -1, 0), (5, 0.0, 12, 0.0, 4, 0.0, 0.5, -1, 0),
    # runs of long paragraphs outside the article of a page that has one (a teaser, say)
    (120, 0.0, 95, 0.0, 110, 0.0, 0, 0, 1), (100, 0.02, 130, 0.0, 90, 0.0, 0, 0, 1), (150, 0.0, 100, 0.01, 140, 0.0, 0, 0, 1),
    # pages without an article or main element
    (60, 0.0, 8, 0.0, 45, 0.0, 0, -1, 1), (45, 0.05, 60, 0.0, 50, 0.0, 0, -1, 1), (150, 0.0, 0, 0.0, 3, 1.0, 0, -1, 1),
    (8, 0.0, 2, 1.0, 60, 0.0, 0, -1, 1), (6, 0.0, 60, 0.0, 70, 0.0, 0, -1, 1), (25, 0.0, 6, 0.0, 40, 0.0, 0, -1, 1),
    (4, 0.0, 45, 0.0, 60, 0.0, 0, -1, 1), (30, 0.1, 30, 0.1, 30, 0.1, 0, -1, 1), (18, 0.0, 40, 0.0, 5, 1.0, 0, -1, 1),
    (12, 0.0, 30, 0.0, 25, 0.0, 0, -1, 1), (100, 0.2, 5, 0.0, 8, 0.0, 0, -1, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, -1, 1),
    (13, 0.0, 13, 0.0, 13, 0.0, 0, -1, 1), (13, 0.0, 0, 0.0, 13, 0.0, 0, -1, 1), (13, 0.0, 13, 0.0, 2, 1.0, 0, -1, 1),
    (35, 0.0, 40, 0.0, 2, 1.0, 0, -1, 1), (28, 0.0, 2, 1.0, 3, 1.0, 0, -1, 1), (70, 0.0, 30, 0.0, 0, 0.0, 0, -1, 1),
    (11, 0.0, 25, 0.0, 4, 0.0, 0, -1, 1), (50, 0.0, 6, 0.0, 12, 0.0, 0, -1, 1), (24, 0.04, 3, 0.0, 10, 0.0, 0, -1, 1),
    (10, 0.0, 12, 0.0, 11, 0.0, 0, -1, 1), (15, 0.0, 11, 0.0, 0, 0.0, 0, -1, 1), (95, 0.0, 4, 1.0, 6, 0.0, 0, -1, 1),
    (5, 1.0, 4, 1.0, 6, 1.0, 0, -1, 0), (2, 1.0, 1, 1.0, 30, 0.0, 0, -1, 0), (9, 0.8, 12, 0.9, 8, 1.0, 0, -1, 0),
    (25, 0.9, 20, 0.9, 15, 1.0, 0, -1, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, -1, 0), (6, 0.0, 3, 1.0, 0, 0.0, 0, -1, 0),
    (40, 0.6, 30, 0.7, 5, 1.0, 0, -1, 0), (1, 1.0, 60, 0.0, 0, 0.0, 0, -1, 0), (4, 0.0, 5, 0.0, 3, 0.0, 0, -1, 0),
    (7, 0.5, 4, 1.0, 6, 1.0, 0, -1, 0), (2, 0.0, 0, 0.0, 3, 1.0, 0, -1, 0), (12, 1.0, 40, 0.0, 45, 0.0, 0, -1, 0),
)

#: Blocks of pages that mark their article count so often, as such marks say more than lengths do.
MARKED_WEIGHT = 6.0

# Element names of HTML by their part in a page.
DROPPED = "script style noscript template svg math iframe object canvas audio video select option textarea button head title map"
INLINE = (
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr"
)
SIDE = "nav header footer aside form dialog menu menuitem address fieldset"
MAIN = "article main"
ENCLOSING = f"{SIDE} {MAIN} body div section table tbody tr td th ul ol dl li figure details center blockquote p span a"
# Words of class, id and role that mark a part as not the article.
HINTS = (
    "ad ads adv advert advertisement advertisements advertising adslot adbox banner sponsor sponsored promo promotion popup modal "
    "overlay cookie cookies consent gdpr notice notices alert sidebar side widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager toolbar footer header masthead comment comments commentlist disqus respond replies "
    "reply discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search form copyright legal disclaimer tags complementary contentinfo banner-top skip"
)
DROPPED_SET, INLINE_SET, SIDE_SET, MAIN_SET, ENCLOSING_SET, HINT_SET = (
    frozenset(x.split()) for x in (DROPPED, INLINE, SIDE, MAIN, ENCLOSING, HINTS)
)

# What begins with a "<": a comment, other things that are not elements, a tag, or a broken tag, which ends with the next
# ">" or before the next "<" and so never makes a later one be read twice.
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?:(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<broken>[^<>]*+)(?:>|(?=<)|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def side_of(name: str, rest: str) -> float:
    """1 if an element is something other than content, by its name or attributes, 0.5 if only a part of
    a class or id says so, else 0."""
    if name in SIDE_SET:
        return 1.0
    if name in MAIN_SET or name == "body" or "=" not in rest and "hidden" not in rest:
        return 0.0
    found = 0.0
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 1.0
        for token in value.split():
            if token.lower() in HINT_SET:
                return 1.0
            if any(p.lower() in HINT_SET for p in PARTS.findall(token)):
                found = 0.5
    return found


def blocks_of(page: str) -> list[tuple[str, int, float, float, int]]:
    """(text, words, link density, side, main) of each block with a word, in page order.

    A main element ends the marks around it; the first article does so for marks by a part of a name and
    leaves others as doubtful. Marks inside of either stay."""
    found, pieces, linked = [], [], []
    stack: list[tuple[str, float, int]] = []  # names, with the marks outside of each
    side, main, links = 0.0, 0, 0
    any_main = False
    at, size = 0, len(page)
    ends: dict[str, re.Pattern | None] = {}  # closing tags of dropped elements, None once there are no more

    def flush() -> None:
        if pieces:
            text = html.unescape("".join(pieces))
            words = text.split()
            if words:
                in_links = len(html.unescape(" ".join(linked)).split())
                found.append((" ".join(words), len(words), min(1.0, in_links / len(words)), side, main))
            pieces.clear()
            linked.clear()

    def say(text: str) -> None:
        if text:
            pieces.append(text)
            if links:
                linked.append(text)

    while at < size:
        begin = page.find("<", at)
        say(page[at:begin] if begin >= 0 else page[at:])
        if begin < 0:
            break
        tag = TAG.match(page, begin)
        if tag is None:
            say("<")
            at = begin + 1
            continue
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        rest = tag["rest"] if tag["rest"] is not None else tag["broken"]
        if name in DROPPED_SET and not tag["close"]:
            if not rest.endswith("/"):
                close = ends.setdefault(name, re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I))
                end = close.search(page, at) if close else None
                if end:
                    at = end.end()
                else:
                    # What follows an element that is never closed is read on, unless it is code.
                    ends[name] = None
                    at = size if name in ("script", "style") else at
            if name not in INLINE_SET and name not in ("svg", "math", "button", "map", "object"):
                flush()
            continue
        if name not in INLINE_SET:
            flush()
        elif name == "br":
            say("\n")
        if name == "a":
            links = 0 if tag["close"] else 1
        if name not in ENCLOSING_SET:
            continue
        if tag["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    _, side, main = stack[i]
                    del stack[i:]
                    break
                if name in ("p", "span", "a", "li") and stack[i][0] not in ("p", "span", "a", "li"):
                    break
        elif not rest.endswith("/"):
            if name in ("p", "li") and stack and stack[-1][0] == name:
                _, side, main = stack.pop()
            stack.append((name, side, main))
            if name in MAIN_SET:
                if name == "main":
                    side = 0.0
                elif not main:
                    side = 0.5 if side == 1 else 0.0
                main, any_main = 1, True
            else:
                side = max(side, side_of(name, rest))
    flush()
    return [(t, w, d, s, m if any_main else -1) for t, w, d, s, m in found]


def described(blocks: list[tuple]) -> list[tuple[float, ...]]:
    """Features of each block; there is no word beyond the first and the last."""
    ends = [(0, 0.0)]
    around = ends + [(b[1], b[2]) for b in blocks] + ends
    return [(*around[i + 1], *around[i], *around[i + 2], b[3], b[4]) for i, b in enumerate(blocks)]


def fit(spark: SparkSession, labelled: tuple = LABELLED, depth: int = 7) -> tuple:
    """A decision tree over ``FEATURES`` as nested (feature, threshold, low, high) with labels as leaves."""
    weighted = [(*map(float, r), 1.0 if r[7] < 0 else MARKED_WEIGHT) for r in labelled]
    rows = spark.createDataFrame(weighted, [*FEATURES, "label", "weight"]).coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = DecisionTreeClassifier(maxDepth=depth, weightCol="weight", seed=7).fit(vectors)
    return nested(model._java_obj.rootNode())


def main_text(page: str | None, tree: tuple) -> str:
    blocks = blocks_of(page or "")
    kept = []
    for block, features in zip(blocks, described(blocks)):
        node = tree
        while isinstance(node, tuple):
            feature, threshold, low, high = node
            node = low if features[feature] <= threshold else high
        if node == 1.0:
            kept.append(block[0])
    return "\n".join(kept)


def extract(df: DataFrame, page: str, keep: tuple[str, ...], labelled: tuple = LABELLED) -> DataFrame:
    """The columns ``keep`` of each row, and ``text``: the main text of the page.

    Null and empty pages, and pages without main text, give an empty text. White space inside a block
    is one space, blocks are joined by one newline; nothing is cut off. Rows may repeat; other columns
    of ``df`` are not read. ``keep`` must not hold a column named text.
    """
    tree = fit(df.sparkSession, labelled)
    chosen = df.select(*keep, page)
    fields = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page):
            texts = [main_text(p, tree) for p in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text"])

    return chosen.mapInArrow(run, f"{fields}, text string")
