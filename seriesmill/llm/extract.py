"""Main text of web pages: the maximum-scoring contiguous run of tokens.

A page is a sequence of word and tag tokens. A word's score depends on the element it stands in, a tag's on its name,
or on the boilerplate that either stands in; all are log-odds fitted to labelled pages, where the label of a token is whether it lies in the page's main element
(<article> or <main>). A linear scan finds the best contiguous region. Within the region, blocks of navigation, forms,
adverts, comments and the like are left out, and the rest becomes the text. Forms and marked elements that wrap the main
element are not boilerplate.
"""

from __future__ import annotations

import html
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Elements whose content is no text of a page. That of the first runs to its end tag whatever it holds, and to the end of
#: the page without one, as browsers read it; the others end with their parent at the latest.
RAW = frozenset("script style textarea title iframe".split())
HIDDEN = frozenset("noscript template svg math object canvas select option button".split())
#: Elements that are no main text, but for a header within the main element and a form around it.
BOILERPLATE = frozenset("nav header footer aside form dialog menu".split())
#: Parts of a class, id or role that mark boilerplate, as whole words between separators.
MARKS = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion banner sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header footer masthead cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related recommended comment comments disqus reply replies login search toolbar pagination pager skip".split())
#: Of these, the words that also stand on parts of an article; an element with no other mark is text if it holds PROSE words
#: of paragraphs outside links.
SOFT = frozenset("related search header skip recommended sharing reply".split())
PROSE = 20
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Further elements whose tags have weights of their own; all others share one.
INLINE = frozenset("a abbr audio b big button cite code del dfn em font i ins kbd label legend mark option picture q rp rt ruby s samp select small span strike strong sub sup time tt u var video".split())
#: Elements that a new one of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BUTTON_END = re.compile("</button", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\S+")


@dataclass
class Weights:
    """Log-odds of words by context and of tags by name; what is not in them scores the default."""

    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    word_default: float = 1.0
    tag_default: float = -1.0


#: Used where no labelled page is at hand.
_PLAIN = "p b i em strong br h1 h2 h3 ul ol li blockquote span".split()
DEFAULT = Weights(
    {"p": 1.0, "h1": 1.0, "a": -0.2, "boilerplate": -2.0, "inner": 0.0},
    {t: -0.1 for n in _PLAIN for t in (n, "/" + n)} | {"article": 3.0, "main": 3.0, "/article": -3.0, "/main": -3.0, "inner tag": 0.0, "boilerplate tag": -1.0},
    0.5, -1.0,
)


def mark_of(name: str, attributes: str, inside_main: bool) -> int:
    """0 for no boilerplate, 1 for a form or a word of MARKS in class, id or role, 2 for another boilerplate element, 3 if
    only words of SOFT are there."""
    if name == "header" and inside_main:
        return 0
    if name in BOILERPLATE:
        return 1 if name == "form" else 2
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    found = {w for _, a, b, c in _ATTR.findall(attributes) for w in re.split(r"[^a-z0-9]+", (a or b or c).lower())} & MARKS
    return 0 if not found else 3 if found <= SOFT else 1


@dataclass(slots=True)
class Element:
    """An open element. at: where its tag starts; mark: as mark_of; bad, main, hidden: it or an element around it is."""

    name: str
    at: int
    mark: int = 0
    bad: bool = False
    main: bool = False
    hidden: bool = False


def walk(page: str, ignored: frozenset[int] = frozenset()) -> Iterator[tuple[str, str, list[Element]]]:
    """Kind, value and the elements open there, outermost first (the list changes as the walk goes on). Marks of the
    elements at `ignored` don't count."""
    stack: list[Element] = []
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        m = _TOKEN.match(page, lt) if lt < n else None
        if m is None and lt < n:  # a bare '<' is text
            nxt = page.find("<", lt + 1)
            lt = n if nxt < 0 else nxt
            while lt < n and (m := _TOKEN.match(page, lt)) is None:
                nxt = page.find("<", lt + 1)
                lt = n if nxt < 0 else nxt
        if lt > at and not (stack and stack[-1].hidden):
            yield "text", page[at:lt], stack
        if m is None:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name, attributes = name.lower(), m[3]
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            if name not in HIDDEN and not (stack and stack[-1].hidden):
                yield "tag", "/" + name, stack
            continue
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in BLOCKS and stack and stack[-1].name == "button" and not _BUTTON_END.search(page, at):
            stack.pop()  # a button that nothing closes ends before the next block
        if name in BLOCKS and name not in ("td", "th", "tr", "li", "dt", "dd") and stack and stack[-1].name == "p":
            stack.pop()
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in CLOSES.get(name, ()):
                del stack[k:]
                break
            if stack[k].name in BLOCKS:
                break
        above = stack[-1] if stack else Element("", 0)
        main = above.main or name in MAIN
        mark = 0 if m.start() in ignored else mark_of(name, attributes, main)
        hidden = above.hidden or name in HIDDEN
        if name not in VOID and not attributes.endswith("/"):
            stack.append(Element(name, m.start(), mark, above.bad or mark > 0, main, hidden))
        if not hidden:
            yield "tag", name, stack


def wrappers(page: str) -> frozenset[int]:
    """Where the forms and marked elements stand whose marks say nothing: those that only wrap the page's main element, and
    within it those with SOFT marks alone that hold prose.

    The main element is the <main> with most words, or else, of the outermost articles with the fewest marked elements
    around them, the one with most words, if it has more words than the page has outside all marked elements. Within it,
    an article with more than half of its words takes its place: comments are articles too."""
    if not re.search(r"<(?:article|main)\b", page, re.I):
        return frozenset()
    words: Counter = Counter()
    prose: Counter = Counter()
    found: dict[int, tuple[str, list[Element]]] = {}
    for kind, value, stack in walk(page):
        if kind == "text":
            k = len(_WORD.findall(value))
            if not (stack and stack[-1].bad):
                words[-1] += k
            plain = any(e.name == "p" for e in stack) and not any(e.name == "a" for e in stack)
            for e in stack:
                if e.name in MAIN:
                    words[e.at] += k
                elif e.mark == 3 and e.main and plain:
                    prose[e.at] += k
        elif value in MAIN and stack and stack[-1].name == value and not any(e.mark == 2 for e in stack):
            found[stack[-1].at] = value, stack[:-1]
    soft = frozenset(at for at, k in prose.items() if k >= PROSE)
    if not any(e.mark for _, around in found.values() for e in around):
        return soft
    marked = {at: {e.at for e in around if e.mark} for at, (_, around) in found.items()}
    outer = [at for at, (_, around) in found.items() if words[at] and not any(e.at in found for e in around)]
    mains = [at for at in outer if found[at][0] == "main"]
    best = max(mains or outer, key=lambda at: (0 if mains else -len(marked[at]), words[at]), default=None)
    if best is None or (not mains and marked[best] and words[best] <= words[-1]):
        return soft
    while inner := [at for at, (_, around) in found.items() if any(e.at == best for e in around) and 2 * words[at] > words[best]]:
        best = min(inner)
    return soft | marked[best]


def tokens(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(kind, value, context, within main, block boundary): kind 'tag' with its name ('/' first for an end), or 'text'
    with the raw characters between two tags. context: the nearest block or link element, 'boilerplate', or 'inner' for boilerplate within the main element."""
    for kind, value, stack in walk(page, wrappers(page)):
        context, main = "", bool(stack) and stack[-1].main
        if stack and stack[-1].bad:
            context = "inner" if main else "boilerplate"
        else:
            context = next((e.name for e in reversed(stack) if e.name == "a" or e.name in BLOCKS), "")
        boundary = kind == "tag" and value.removeprefix("/") in BLOCKS
        yield kind, value, context, main, boundary


def tag_feature(value: str, context: str) -> str:
    if context in ("boilerplate", "inner"):
        return f"{context} tag"
    name = value.removeprefix("/")
    return value if name in BLOCKS or name in VOID or name in INLINE or name in MAIN else "other tag"


def counts(page: str) -> Counter:
    """(kind, feature, within main): number, over a page's tokens; empty for a page without a main element."""
    out: Counter = Counter()
    for kind, value, context, main, _ in tokens(page):
        if kind == "text":
            if k := len(_WORD.findall(value)):
                out["word", context, main] += k
        else:
            out["tag", tag_feature(value, context), main] += 1
    return out if any(k[2] for k in out) else Counter()


def fitted(total: dict[tuple[str, str, bool], int]) -> Weights:
    """Log-odds with one added to each count; a word in main text is worth at most 2, the best tag nothing."""
    if not total:
        return DEFAULT
    w = Weights()
    for kind, limit, into in (("word", 2.0, w.word), ("tag", 0.0, w.tag)):
        for f in {k[1] for k in total if k[0] == kind}:
            odds = math.log((total.get((kind, f, True), 0) + 1) / (total.get((kind, f, False), 0) + 1))
            into[f] = max(-4.0, min(limit, odds))
    # A main element's own tags stand at its edges; everything that is rare stays with the defaults.
    w.word_default, w.tag_default = 0.5, -1.0
    return w


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum; the first and shortest of equals; (0, 0) if none is above 0."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-12:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights = DEFAULT) -> str:
    """The blocks of the best region, white space inside a block as one space, joined by two newlines."""
    if not page:
        return ""
    seq = list(tokens(page))
    scores = []
    for kind, value, context, _, _ in seq:
        if kind == "text":
            scores.append(len(_WORD.findall(value)) * weights.word.get(context, weights.word_default))
        else:
            scores.append(weights.tag.get(tag_feature(value, context), weights.tag_default))
    start, end = best_region(scores)
    blocks, now = [], []
    for kind, value, context, _, boundary in seq[start:end]:
        if kind == "text":
            if context not in ("boilerplate", "inner"):
                now.append(value)
        elif boundary:
            blocks.append("".join(now))
            now = []
        elif value == "br":
            now.append(" ")
    blocks.append("".join(now))
    texts = (_SPACE.sub(" ", html.unescape(b)).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def learn(pages: DataFrame, sample: int = 2000) -> Weights:
    """Weights from the pages with a main element among at most `sample` pages, chosen by a hash of page_id and url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                total += counts(page or "")
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys]), pa.array([total[k] for k in keys], pa.int64())], ["kind", "feature", "main", "n"])

    n = pages.count()
    share = min(1.0, sample / max(1, n))
    chosen = pages.where(F.pmod(F.xxhash64(F.lit(3), "page_id", "url"), F.lit(1_000_003)) < share * 1_000_003).select("html")
    rows = arrow_map(chosen, run, "kind string, feature string, main boolean, n long").groupBy("kind", "feature", "main").agg(F.sum("n").alias("n"))
    return fitted({(r.kind, r.feature, r.main): r.n for r in rows.collect()})  # contexts and known names: some hundred rows


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row: its main text ('' for a null, empty or textless page), and its length
    in code points. Ids and urls stay as they are, null and repeated ones too; other columns are ignored."""
    packed = pickle.dumps(weights or learn(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = pickle.loads(packed)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                s = b.slice(i, 500)
                text = [main_text(x.as_py(), w) for x in s.column(2)]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long")
