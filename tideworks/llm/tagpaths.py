"""Main text of web pages by tag-path ratios.

Each block of text belongs to the path of tags from the root to it.  Text length and punctuation are summed per path
and divided by the path's number of blocks; the two ratios are smoothed over the page's order of blocks and fused by
multiplication.  Paths whose fused ratio reaches a share of the best are content paths, and the content is the
deepest element that holds most of their text, without link lists and the parts that markup names as not content.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed svg canvas select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend option tbody td tfoot th thead tr".split()) | {"dl"}
ENDS = {"li": ("li", frozenset(("ul", "ol", "menu", "dir"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "tr": ("tr", frozenset(("table", "tbody", "thead", "tfoot"))), "option": ("option", frozenset(("select",)))}
APART = frozenset("nav footer aside form head button menu dialog fieldset label datalist map audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
# Words of class and id attributes that name parts beside the article.
NAMES = frozenset("ad ads adv advert advertisement advertising adsense adbox banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register sidebar aside widget widgets related recommended recommendations share sharing social comment comments reply replies respond disqus discussion menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar copyright disclaimer skip hidden".split())

CONTAINERS = frozenset(("", "html", "body", "article", "main", "section", "div", "center"))

# Of these, names that parts of an article itself may have too, and words that class names add to any of them.
DOUBTFUL = frozenset("alert copyright disclaimer discussion notice notices promo promotion recommended related share sharing social widget widgets".split())
ADDED = frozenset("area article articles bar block body bottom box btn button buttons center col column container content div element footer group header holder icon icons id inline inner item items js left link links list main media middle modal module outer page panel post posts right row section site slot small sticky story stories text title top unit wrap wrapper".split())

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+""")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_TITLES = re.compile(r"/(?:h[1-6]|p)(?:/|\Z)")  # headings and paragraphs, which no link list is made of
_PUNCTUATION = re.compile(r"[,.;:!?¡¿、。！，？]")


@dataclass(frozen=True)
class PathRules:
    """share: of the best fused ratio, for a content path; article_hold: of content text, for article and main elements to be chosen; link_share: above it a path is a link list; doubtful_share: of the best ratio, for the path of a part whose name leaves doubt."""

    share: float = 0.1
    article_hold: float = 0.3
    link_share: float = 0.8
    doubtful_share: float = 0.5


@dataclass
class _Block:
    text: str
    path: str
    elements: tuple[int, ...]
    link_chars: int
    doubtful: bool


TEXT, OPEN, CLOSE = range(3)


def _tokens(page: str) -> Iterator[tuple[int, str, str]]:
    """(TEXT, text, ""), (OPEN, tag, attributes) and (CLOSE, tag, "").

    One pass: once a tag is found to have a quote that nothing closes, quotes count no more; a < that no > follows is
    text, as is all after it; comments and raw elements that are never closed end the page.
    """
    at, quotes = 0, True
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            yield TEXT, page[at:], ""
            return
        if start > at:
            yield TEXT, page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end < 0:
                return
            at = end + 3
            continue
        name = _NAME.match(page, start)
        if not name and page[start + 1 : start + 2] not in ("!", "?", "/"):
            yield TEXT, "<", ""
            at = start + 1
            continue
        after = name.end() if name else start + 2
        end = -1
        if name and quotes:
            end = _QUOTED.match(page, after).end()
            if end >= len(page) or page[end] != ">":
                end, quotes = -1, False
        if end < 0:
            end = page.find(">", after)
        if end < 0:
            yield TEXT, page[start:], ""
            return
        at = end + 1
        if not name:
            continue
        tag, closing = name.group(1).lower(), page[start + 1] == "/"
        if tag in RAW:
            if not closing:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if not close:
                    return
                at = close.end()
            continue
        yield (CLOSE, tag, "") if closing else (OPEN, tag, page[after:end])


CLEAR, DOUBT, APART_ = 0, 1, 2


def _apart(tag: str, attrs: str, inside_article: bool) -> int:
    """Whether markup sets an element apart from the article, or leaves it in doubt."""
    if tag in APART or tag == "header" and not inside_article:
        return APART_
    found = CLEAR
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for one in value.split():
                words = set(_WORDS.findall(one))
                named = words & NAMES
                if not named or words - NAMES - ADDED or tag in ("article", "main", "body", "html") and not named & {"comment", "comments", "reply"}:
                    continue
                if not inside_article or named - DOUBTFUL:
                    return APART_
                found = DOUBT
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return APART_
    return found


def blocks(page: str) -> tuple[list[_Block], dict[int, str]]:
    """Blocks of text outside parts that are not content, in page order, and the tag of each element by number."""
    found: list[_Block] = []
    tags: dict[int, str] = {}
    # Open elements: tag, number, path of block tags, whether in a part apart or in doubt, whether in an article, whether in a link.
    stack: list[tuple[str, int, str, int, bool, bool]] = [("", 0, "", CLEAR, False, False)]
    pieces: list[tuple[str, bool]] = []
    owner = (0, "", CLEAR)

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join([p for p, _ in pieces])).split())
            if text and owner[2] != APART_:
                links = sum([len(p.strip()) for p, linked in pieces if linked])
                found.append(_Block(text, owner[1], tuple([e[1] for e in stack_of_owner]), links, owner[2] == DOUBT))
            pieces.clear()

    stack_of_owner: list = []
    for kind, text, attrs in _tokens(page):
        if kind == TEXT:
            if not pieces:
                if text.isspace():
                    continue
                top = stack[-1]
                owner = (top[1], top[2], top[3])
                stack_of_owner = list(stack)
            pieces.append((text, stack[-1][5]))
            continue
        tag = text
        if kind == CLOSE:
            if tag in BLOCK:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break
            continue
        if tag == "br":
            pieces.append(("\n", False)) if pieces else None
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                _close(stack, ("p",), BLOCK - {"p"})
            if tag in ENDS:
                names, until = ENDS[tag]
                _close(stack, tuple(names.split()), until)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        _, _, path, apart, article, link = stack[-1]
        number = len(tags) + 1
        tags[number] = tag
        state = _apart(tag, attrs, article) if apart != APART_ else APART_
        mark = "~" if state == DOUBT else ""  # what is in doubt has a path of its own
        stack.append((tag, number, f"{path}/{tag}{mark}" if tag in BLOCK or mark else path, max(apart, state), article or tag in ("article", "main"), link or tag == "a"))
    flush()
    return found, tags


def _close(stack: list, names: tuple[str, ...], until: frozenset[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth][0] in names:
            del stack[depth:]
            return
        if stack[depth][0] in until:
            return


KERNEL = (0.06, 0.24, 0.4, 0.24, 0.06)  # a Gaussian of standard deviation 1


def _smooth(values: list[float]) -> list[float]:
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for k, w in enumerate(KERNEL, i - 2):
            if 0 <= k < n:
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def main_text(page: str | None, rules: PathRules = PathRules()) -> str:  # noqa: B008
    """The page's main text, its blocks joined by line ends; empty if it has none or page is null."""
    found, tags = blocks(page or "")
    if not found:
        return ""
    sums: dict[str, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for b in found:
        s = sums[b.path]
        for k, x in enumerate((1, len(b.text) - min(b.link_chars, len(b.text)), len(_PUNCTUATION.findall(b.text)), b.link_chars)):
            s[k] += x
    lengths = _smooth([sums[b.path][1] / sums[b.path][0] for b in found])
    marks = _smooth([sums[b.path][2] / sums[b.path][0] for b in found])
    fused: dict[str, float] = defaultdict(float)
    for b, length, mark in zip(found, lengths, marks, strict=True):
        fused[b.path] += length * (1 + mark) / sums[b.path][0]
    least = rules.share * max(fused.values())
    plain = {p: x[1] * (x[0] + x[2]) / x[0] ** 2 for p, x in sums.items()}  # not smoothed: a part in doubt gains nothing by its neighbours
    doubted = [b.doubtful and plain[b.path] < rules.doubtful_share * max(plain.values()) for b in found]
    lists = {p for p, s in sums.items() if s[3] > rules.link_share * (s[1] + s[3])}
    articles_of = [[e for e in b.elements if tags.get(e) in ("article", "main")] for b in found]
    in_list = [d or b.path in lists and not within and not _TITLES.search(b.path) for b, within, d in zip(found, articles_of, doubted, strict=True)]
    held: dict[int, int] = defaultdict(int)
    total = in_articles = 0
    content = [i for i, b in enumerate(found) if fused[b.path] >= least and not in_list[i]]
    for i in content:
        n = len(found[i].text)
        total += n
        in_articles += n if articles_of[i] else 0
        for e in found[i].elements:
            held[e] += n
    if not total:
        return ""
    if in_articles and in_articles >= rules.article_hold * total:  # each outermost one, as deep as one holds all its content text
        tops = {min(articles_of[i]): articles_of[i] for i in content if articles_of[i]}
        chosen = {max(e for e in within if held[e] == held[top]) for top, within in tops.items()}
    else:  # the deepest that holds all of it
        chosen = {max(e for e in held if tags.get(e, "") in CONTAINERS and held[e] == total)}
    inside = [not chosen.isdisjoint(b.elements) and not x for b, x in zip(found, in_list, strict=True)]
    if not any(x and b.path.endswith("/h1") for b, x in zip(found, inside, strict=True)):  # a title set above the element
        for i in range(inside.index(True) - 1, -1, -1):
            if found[i].path.endswith("/h1"):
                inside[i] = True
                break
    return "\n".join([b.text for b, x in zip(found, inside, strict=True) if x])


def extract(pages: DataFrame, rules: PathRules | None = None, html: str = "html") -> DataFrame:
    """pages without its html, with ``text`` and ``n_chars`` (columns of pages by these names give way).

    Pages are read alone, in one pass each, so repeated rows and empty tables need nothing special; null and empty
    pages give the empty text.  No shuffle.
    """
    rules = rules or PathRules()
    carried = [f for f in pages.schema.fields if f.name not in {html, "text", "n_chars"}]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, rules) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["text string", "n_chars bigint"])
    return pages.select(*[f"`{c}`" for c in names], f"`{html}`").mapInArrow(run, schema)
