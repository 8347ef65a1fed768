"""Main text of web pages by line-block distribution.

1. Markup is stripped. Every block element begins a new line. Text inside elements that are
   never the article (menus, footers, forms, scripts, adverts, comments and the like, by
   element, role and class names) leaves an empty line. Inside a marked article names count
   only as whole classes or roles, headings are never skipped by name, and sections with such
   a name are text that the block sums judge.
2. A line's block is the sum of the text lengths of a sliding window of lines that starts
   there. In the sequence of the block sums a surge is where the sum rises above a threshold
   after text was thin, a dive is where it has fallen to zero; lines between a surge and the
   next dive are kept. Lines of links make no surge; those between two kept lines are kept.
3. A page that marks its articles (``article``, ``main``, or a role or property that says so)
   gives its lines weights: in an article any text is a surge, outside only much text is.
   All articles count but comments and teasers; those in an element that is skipped and closed
   count only if there are no others, those in a comment section never. Lines of each weight
   have block sums of their own.

Markup may be broken: elements that are never closed, or a page that breaks off.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
#: Block sum from which on unmarked text is a surge, in code points.
SURGE = 80
#: Share of link text from which on a line of an unmarked page is a menu.
LINKED = 0.5
#: Share of a page from which on an element is the page itself, whatever its name.
MOST = 0.8
#: Weight of text outside the articles of a page that marks them.
UNMARKED = 0.25

# Elements by what they mean for the text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "applet audio button canvas datalist dialog embed fieldset footer form head iframe input map menu nav noframes noscript "
    "option select svg template textarea title video aside".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark something else than the article.
OTHER = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disclaimer disqus dialog feedback form gdpr login menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pagination popup promo promoted promotion recommended related replies reply respond "
    "search share sharing sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription tags toc toolbar "
    "topbar tracking widget widgets".split()
)
#: The same, but only outside the article: inside, these belong to it.
OUTSIDE = frozenset("alert contentinfo copyright foot footer head header masthead secondary search site".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words before one of the above that say an element only has, or lacks, such a part.
_HAVING = frozenset("with has have no without show hide".split())
_MARKED = re.compile(r"""(?:role\s*=\s*["']?(?:main|article)\b|itemprop\s*=\s*["']?articleBody\b)""", re.IGNORECASE)
_HIDDEN = re.compile(
    r"""(?:^|\s)hidden(?=\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""",
    re.IGNORECASE,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_CLASSES = re.compile(r"""(?:^|\s)(?:class|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
#: Whole names of comments and of the parts of a comment section.
_COMMENTS = re.compile(
    r"(?:(?:post|article|page|entry|user|reader|all|wp)[-_])?(?:comments?|commentlist|disqus|repl(?:y|ies)|respond)"
    r"(?:[-_]?(?:list|area|section|thread|wrap|wrapper|container|block|box|body|content|\d+))*"
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|xmp)\b[^>]*>.*?(?:</\1\s*>|$)|<(annotation(?:-xml)?)\b[^>]*>.*?</\2\s*>|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)",
    re.IGNORECASE | re.DOTALL,
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|$)""")


class Line:
    """Text of one block, with the length of its links and where it stands.

    ``article`` is the number of its article or 0, ``doubted`` says that a section's name speaks
    against it, ``aside`` that it is in an element that was skipped up to an article.
    """

    __slots__ = ("parts", "linked", "article", "doubted", "aside")

    def __init__(self, article: int, doubted: int = 0, aside: bool = False):
        self.parts: list[str] = []
        self.linked = 0
        self.article = article
        self.doubted = doubted
        self.aside = aside

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _whole(attributes: str) -> list[str]:
    """The whole names in class and role."""
    return [name.lower() for value in _CLASSES.findall(attributes) for name in value.strip("\"'").split()]


def _other(attributes: str, inside: bool) -> bool:
    """Whether names or style say that an element isn't part of the article."""
    if not attributes.strip():
        return False
    if _HIDDEN.search(attributes):
        return True
    if inside:
        return any(name in OTHER or _COMMENTS.fullmatch(name) for name in _whole(attributes))
    for value in _NAMES.findall(attributes):
        words = [word.lower() for word in _PARTS.findall(value)]
        for before, word in zip(["", *words], words):
            if before not in _HAVING and (word in OTHER or word in OUTSIDE):
                return True
    return False


def _other_article(attributes: str) -> bool:
    """Whether an article element is a comment, a teaser or hidden: by whole names only."""
    if _HIDDEN.search(attributes):
        return True
    names = (name.lower() for value in _NAMES.findall(attributes) for name in value.strip("\"'").split())
    return any(name in OTHER or name.startswith(("comment", "teaser")) for name in names)


def _of_comments(name: str, attributes: str) -> bool:
    """Whether an element is, by a whole name, a section of comments."""
    if not attributes or name in HEADINGS or name in ("p", "span", "a"):
        return False
    names = (part.lower() for value in _NAMES.findall(attributes) for part in value.strip("\"'").split())
    return any(map(_COMMENTS.fullmatch, names))


def _ends(page: str) -> dict[int, int]:
    """Where the elements that are closed end, by where they start."""
    ends: dict[int, int] = {}
    starts: dict[str, list[int]] = {}
    for tag in _TAG.finditer(page):
        own = starts.setdefault((tag[2] or tag[6]).lower(), [])
        if not (tag[1] or tag[5]):
            own.append(tag.start())
        elif own:
            ends[own.pop()] = tag.end()
    return ends


def stripped(page: str) -> list[Line]:
    """The lines of a page; skipped elements leave an empty one.

    A name on an element that holds most of the page speaks of the page, unless it says comments.
    """
    page = _UNSEEN.sub(" ", page)
    lines = [Line(0)]
    doubted = 0  # open sections of an article, from the one on whose name raises doubt
    article, articles, depth = 0, 0, 0  # number of the article, how many there were, its open elements
    opened: list[str] = []  # names of the elements that opened an article, inside each other
    skipped, nested, in_link, at = "", 0, 0, 0
    since, comments, inner = 0, False, 0  # of what is skipped: its start, its kind, open elements in it named as the article's
    until, ends = 0, None  # end of an element that was skipped up to an article

    def line() -> Line:
        return Line(article, doubted, at < until)

    def new_line() -> None:
        if lines[-1].parts:
            lines.append(line())
        else:
            lines[-1].article, lines[-1].doubted, lines[-1].aside = article, doubted, at < until

    for tag in _TAG.finditer(page):
        if not skipped and tag.start() > at:
            text = page[at : tag.start()]
            lines[-1].parts.append(text)
            if in_link:
                lines[-1].linked += len(text.strip())
        at = tag.end()
        if until and at >= until:
            new_line()
            until = 0
        closing, name = tag[1] or tag[5] or "", (tag[2] or tag[6]).lower()
        attributes = tag[3] or tag[7] or ""
        marks = not closing and (name in ARTICLE or (attributes and _MARKED.search(attributes) is not None))
        other = marks and name != "main" and _other_article(attributes)
        if skipped:
            if marks and not other and skipped not in ARTICLE and not opened and (not comments or name == "main"):
                skipped = ""  # what was never closed ends where the article begins
                if ends is None:
                    ends = _ends(page)
                until = max(until, ends.get(since, 0))
            elif name == skipped:
                if closing:
                    nested -= 1
                elif name in ("p", "li", "option"):
                    nested = 0  # closed by its like; judged anew below
                elif not attributes.rstrip().endswith("/"):
                    nested += 1
                if nested > 0 or closing:
                    if nested <= 0:
                        skipped = ""
                        new_line()
                        lines.append(line())
                    continue
                skipped = ""
            else:
                if closing and name in ("body", "html"):
                    skipped = ""
                elif not opened or name != opened[-1]:
                    continue
                elif not closing:
                    inner += 1
                    continue
                elif inner:
                    inner -= 1
                    continue
                else:
                    skipped = ""  # the article closes before what was opened in it
        if closing:
            if name == "a":
                in_link = 0
            if opened and name == opened[-1]:
                if depth:
                    depth -= 1
                else:
                    new_line()
                    opened.pop()
                    article = articles if opened else 0
                    doubted = 0 if not opened else doubted
                    lines.append(line())
                    continue
            if doubted and name == "section":
                doubted -= 1
            if name in BLOCKS:
                new_line()
            continue
        if name in VOID:
            if name in BLOCKS:
                new_line()
            continue
        if name == "a":
            in_link = 1
        drop = name in NEVER or (name == "header" and not opened)
        if not drop and name not in ("html", "body") and (not marks or other):
            drop = other if marks else _other(attributes, bool(opened))
            if drop and opened and not marks and not _HIDDEN.search(attributes):
                if name in HEADINGS:
                    drop = False
                elif name == "section" and not any(map(_COMMENTS.fullmatch, _whole(attributes))):
                    drop, doubted = False, doubted + 1
                    new_line()
                    lines.append(line())
                    continue
            elif drop and not opened and not marks and not _HIDDEN.search(attributes) and not _of_comments(name, attributes):
                if ends is None:
                    ends = _ends(page)
                drop = ends.get(tag.start(), 0) - tag.start() < MOST * len(page)
        if doubted and name == "section" and not drop:
            doubted += 1
        if drop and not attributes.rstrip().endswith("/"):
            new_line()
            lines.append(line())
            skipped, nested = name, 1
            since, comments, inner = tag.start(), _of_comments(name, attributes), 0
            continue
        if marks:
            new_line()
            if not opened:
                articles += 1
                article = articles
            opened.append(name)
            depth = 0
            lines.append(line())
            continue
        if opened and name == opened[-1]:
            depth += 1
        if name in BLOCKS:
            new_line()
    if not skipped and at < len(page):
        lines[-1].parts.append(page[at:])
    return lines


def between(sums: list[int], lengths: list[int], surge: int) -> list[bool]:
    """Which lines lie between a surge and the next dive of the block sums."""
    kept = [False] * len(sums)
    inside = False
    for place, total in enumerate(sums):
        if not inside and total >= surge and lengths[place]:
            inside = True
        elif inside and total == 0:
            inside = False
        kept[place] = inside
    return kept


def _weights(lines: list[Line], texts: list[str], surge: int) -> list[float]:
    """The weights of the lines of a page that marks its articles; none if there is no text in any.

    An article that is mostly links is a teaser if there are others.
    """
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    usual: dict[int, bool] = {}
    for line, text in zip(lines, texts):
        if line.article and text:
            size[line.article] = size.get(line.article, 0) + len(text)
            links[line.article] = links.get(line.article, 0) + line.linked
            usual[line.article] = usual.get(line.article, True) and not line.aside
    if not size:
        return []
    found = {number for number in size if usual[number]} or set(size)
    written = {number for number in found if links[number] <= LINKED * size[number]} or found

    doubt = any(text and line.article in written and not line.doubted for line, text in zip(lines, texts))

    def weight(line: Line) -> float:
        if not line.article:
            return 0 if line.aside else UNMARKED
        if line.article not in found:
            return 0
        return 1 if line.article not in written or (doubt and line.doubted) else surge

    return [weight(line) for line in lines]


def _kept(lengths: list[float], window: int, surge: int) -> list[bool]:
    """Which lines that count as text are kept, by their block sums."""
    sums = [sum(lengths[place : place + window]) for place in range(len(lengths))]
    return [keep and length > 0 for keep, length in zip(between(sums, lengths, surge), lengths)]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page, one line per block; empty if there is none."""
    if not page:
        return ""
    lines = stripped(page)
    texts = [line.text() for line in lines]
    weights = _weights(lines, texts, surge)
    # Links don't make a surge, but in an article they are text.
    lengths = [
        len(text) if line.linked <= LINKED * len(text) or (weights and weight == surge) else 0
        for line, text, weight in zip(lines, texts, weights or [1] * len(lines))
    ]
    if not weights:
        surge = max(min(surge, max(lengths, default=0)), 1)
        weights = [1] * len(lines)
    kept = [False] * len(lines)
    for own in set(weights) - {0}:
        weighted = [own * length if weight == own else 0 for length, weight in zip(lengths, weights)]
        kept = [keep or here for keep, here in zip(kept, _kept(weighted, window, surge))]
    kept = _with_links(kept, texts, weights)
    return "\n".join(text for text, keep in zip(texts, kept) if keep)


def _with_links(kept: list[bool], texts: list[str], weights: list[float]) -> list[bool]:
    """The kept lines and, where only lines of links lie between two of them, also these."""
    kept, last = list(kept), None
    for place, keep in enumerate(kept):
        if keep:
            if last is not None and all(texts[k] and weights[k] == weights[place] for k in range(last + 1, place)):
                kept[last + 1 : place] = [True] * (place - last - 1)
            last = place
    return kept


def extracted(pages: DataFrame) -> DataFrame:
    """Per page ``page_id, url, text, n_chars`` (code points).

    A null page counts as empty: its text is empty, as is that of a page without an article.
    Rows are independent: repeated rows give equal results, no rows give none, other columns
    are ignored.
    """
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{name} {slim.schema[name].dataType.simpleString()}" for name in ("page_id", "url"))
    return slim.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
