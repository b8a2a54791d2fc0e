"""Main text of web pages: the contiguous run of words and tags with the highest score, found in one scan.

A word scores by the element it stands in and a tag by its name; both weights come from pages whose content is marked up
(``article`` or ``main``). An element that is no content counts as one strongly negative mark, whatever its length. Some tags
say so; else names of classes and ids speak, each with a weight learned from how often it stands inside and outside of
marked content, which starts from a prior for words of page furniture and yields to counts, and prose speaks for content.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# fixed values of HTML and of common page templates
RAW = ("script", "style", "noscript", "template", "textarea", "select", "option", "svg", "iframe", "object", "head", "title", "canvas", "video", "audio")
NOT_CONTENT = ("nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "header")
MARKED = ("article", "main")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "meta", "link", "nobr",
          "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msubsup", "msqrt", "mroot", "mstyle", "mover", "munder", "munderover", "mspace", "semantics")
CONTAINERS = ("article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "ul", "ol", "dl", "table", "body",
              "blockquote", "figure", "details", "button", "span", "p", "center", "address")
# words of page furniture: of any part of a name; of names that consist of them and of words of layout; the last also stand on prose
ANYWHERE = ("ad ads advert adverts advertisement advertising cookie cookies gdpr sidebar navbar breadcrumb breadcrumbs newsletter disqus comments commentlist footer masthead menubar popup").split()
FURNITURE = ("banner nav navigation menu topbar consent modal overlay subscribe subscription signup login comment respond reply replies pagination pager sponsor sponsored promo "
             "promotion toolbar notice notices widget copyright disclaimer").split()
AMBIGUOUS = "aside foot header share sharing social related recommended legal skip tag tags search".split()
LAYOUT = ("area bar block body bottom box button buttons center col column container content cloud form group icon icons inner item items layer left link links list main message outer "
          "page panel post posts right row section site slot stories teaser text title top unit wrap wrapper").split()
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog")

#: score of an element that is no content, whatever its length
SKIPPED = -3.0
#: times that a name is taken to have been seen (inside, outside of content) before any page: of furniture, of ambiguous words, of a part, of others
PRIORS = {"furniture": (1.0, 20.0), "part": (1.0, 9.0), "ambiguous": (1.0, 3.0), "other": (3.0, 1.0)}
#: what so many words of prose (outside of links) in an element add to its log-odds to be content, at most
PROSE, PROSE_WORDS = 1.5, 30
#: score of a tag and of a word of which nothing was learned
TAG, WORD = -0.3, 1.0

_SCAN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ANYWHERE, _FURNITURE, _AMBIGUOUS, _LAYOUT = map(frozenset, (ANYWHERE, FURNITURE, AMBIGUOUS, LAYOUT))
_RAW, _INLINE, _CONTAINERS, _NOT, _MARKED = map(frozenset, (RAW, INLINE, CONTAINERS, NOT_CONTENT, MARKED))


def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


_RAW_ENDS = {n: _raw_end(n) for n in RAW}


@lru_cache(maxsize=100_000)
def prior(name: str) -> str:
    """Which of PRIORS holds for the name of a class or id."""
    parts = [p.lower() for p in _PART.findall(name)]
    known = _ANYWHERE | _FURNITURE | _AMBIGUOUS
    if not any(p in known for p in parts):
        return "other"
    if all(p in known or p in _LAYOUT or p.isdigit() for p in parts):
        return "furniture" if any(p in _ANYWHERE or p in _FURNITURE for p in parts) else "ambiguous"
    return "part" if any(p in _ANYWHERE for p in parts) else "other"


def _element(name: str, attributes: str) -> tuple[str, list[str], bool]:
    """A name for the element by tag, class and id, the names of its classes and ids, and whether other attributes say that it is no content."""
    words, off = [], False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key == "role":
            off |= value.lower() in ROLES
        elif key in ("hidden", "aria-hidden"):
            off |= key == "hidden" or value.lower() == "true"
        else:
            words += value.split()
    return ".".join([name, *sorted(w.lower() for w in words)]), words, off


class Element:
    """An open element: where its parent stands, the names of its classes and ids, whether its tag or attributes rule it out, and its words."""

    __slots__ = ("above", "names", "off", "prose", "linked")

    def __init__(self, above: int, names: list[str], off: bool):
        self.above, self.names, self.off, self.prose, self.linked = above, names, off, 0, 0


def parse(page: str) -> tuple[list[tuple], list[Element]]:
    """Tokens in page order: ("text", string, element name, place, 0) and ("tag", name, is block, place, turn), with the place of
    the element in the list of elements, and 1, -1 or 0 for a tag that opens, closes or neither. The first element is the page."""
    out, elements, stack, at, links = [], [Element(0, [], False)], [], 0, 0  # stack: (tag, element name, place)
    never_closed: set[str] = set()

    def text(upto: int) -> None:
        if upto > at:
            name, place = stack[-1][1:] if stack else ("", 0)
            value = page[at:upto]
            n = len(value.split())
            if links:
                elements[place].linked += n
            else:
                elements[place].prose += n
            out.append(("text", value, name, place, 0))

    end, size = 0, len(page)
    while at < size:
        m = _SCAN.search(page, end)
        if m is None:
            text(size)
            break
        text(m.start())
        at = end = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing, alone = bool(m[1]), m[3].rstrip(">").endswith("/")
        if name in _RAW:
            if not closing and not alone:
                stop = None if name in never_closed else _RAW_ENDS[name].search(page, end)
                if stop is None:
                    never_closed.add(name)
                    if name in ("head", "title", "svg", "noscript"):
                        continue  # its content belongs to the page
                at = end = stop.end() if stop else size
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in _CONTAINERS:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                if name in _MARKED and any(elements[s[2]].off and s[0] not in _MARKED for s in stack):
                    stack.clear()  # an element before it was never closed
                if name == "p" and stack and stack[-1][0] == "p":
                    stack.pop()
                element, names, off = _element(name, m[3]) if len(m[3]) > 1 else (name, [], False)
                inside = any(s[0] in _MARKED for s in stack)
                off = off or (name in _NOT and not (name == "header" and inside))
                if name in _MARKED or name == "body":
                    names, off = [], False
                above = stack[-1] if stack else ("", "", 0)
                plain = element == name and name in ("p", "span", "div", "ul", "ol", "section", "center", "blockquote")
                if not alone:
                    elements.append(Element(above[2], names, off))
                    stack.append((name, above[1] if plain and above[1] else element, len(elements) - 1))
        out.append(("tag", name, name not in _INLINE, stack[-1][2] if stack else 0, -1 if closing else 0 if alone else 1))
    return out, elements


class Weights:
    """Scores of words by element and of tags by name."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.score, self.names = {}, {}
        for feature, (inside, outside) in counts.items():
            if feature[:2] == "c:":
                self.names[feature[2:]] = inside, outside
                continue
            share = (inside + 1.0) / (inside + outside + 2.0)
            self.score[feature] = (2 * share - 1) * WORD if feature[:2] == "w:" else TAG * (2 - 2 * share) - 0.05
        #: elements whose words stood outside of the content on nearly all labelled pages
        self.outside = {f[2:] for f, (i, o) in counts.items() if f[:2] == "w:" and f[2:] not in ("", "body", "html") and o >= 20 and i <= 0.02 * o}

    def word(self, element: str) -> float:
        return self.score.get("w:" + element, WORD)

    def tag(self, name: str) -> float:
        return self.score.get("t:" + name, TAG)

    def odds(self, name: str) -> float:
        """Log-odds that an element with a class or id of this name is content."""
        inside, outside = self.names.get(name.lower(), (0, 0))
        a, b = PRIORS[prior(name)]
        return math.log((inside + a) / (outside + b))

    def skipped(self, elements: list[Element]) -> list[bool]:
        """For each element whether it is no content, or stands in one that is none."""
        prose = [e.prose for e in elements]
        for i in range(len(elements) - 1, 0, -1):
            prose[elements[i].above] += prose[i]
        out = [False]
        for i, e in enumerate(elements[1:], 1):
            off = out[e.above] or e.off
            if e.names and not off:
                off = min(map(self.odds, e.names)) + PROSE * min(1.0, prose[i] / PROSE_WORDS) < 0
            out.append(off)
        return out


def best_run(scores: list[float]) -> tuple[int, int, float]:
    """First and last place and score of the contiguous run with the highest sum, the earliest of equals; (0, -1, 0) if none is positive."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i)
    return *found, best


def extract(page: str, weights: Weights) -> tuple[str, float]:
    """The text of the best run and its score."""
    tokens, elements = parse(page)
    skipped = weights.skipped(elements)
    scores, dropped, was = [], [], False
    for kind, value, extra, place, _ in tokens:
        off = skipped[place] or (kind == "text" and extra in weights.outside)
        dropped.append(off)
        if off:
            scores.append(0.0 if was else SKIPPED)
        elif kind == "text":
            scores.append(len(value.split()) * weights.word(extra))
        else:
            scores.append(weights.tag(value))
        was = off if kind == "text" or off else was
    first, last, score = best_run(scores)
    blocks, parts = [], []
    for (kind, value, extra, *_), off in zip(tokens[first:last + 1], dropped[first:last + 1]):
        if kind == "text" and not off:
            parts.append(html.unescape(value))
        elif off or extra is True:
            blocks.append("".join(parts))
            parts = []
    blocks.append("".join(parts))
    return " ".join(b for b in (" ".join(b.split()) for b in blocks) if b), score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list[int]] = {}
    for batch in batches:
        for page in batch.column(0).to_pylist():
            lowered = page.lower()
            if "<article" not in lowered and "<main" not in lowered:
                continue
            opened, seen = [], 0
            tokens, elements = parse(page)
            for kind, value, extra, place, turn in tokens:
                for e in elements[seen + 1:place + 1]:  # elements opened since
                    for name in e.names:
                        found.setdefault("c:" + name.lower(), [0, 0])[0 if opened else 1] += 1
                seen = max(seen, place)
                if kind == "tag" and value in _MARKED:
                    if turn > 0:
                        opened.append(value)
                    elif turn < 0 and value in opened:
                        while opened.pop() != value:  # one inside it was never closed
                            pass
                    continue
                feature, n = ("w:" + extra, len(value.split())) if kind == "text" else ("t:" + value, 1)
                found.setdefault(feature, [0, 0])[0 if opened else 1] += n
    rows = sorted(found.items())
    yield pa.RecordBatch.from_pydict({"feature": pa.array([f for f, _ in rows], pa.string()), "inside": pa.array([c[0] for _, c in rows], pa.int64()),
                                      "outside": pa.array([c[1] for _, c in rows], pa.int64())})


def fit(pages: DataFrame, *, page: str = "html", most: int = 3_000) -> Weights:
    """Weights from at most about ``most`` pages, chosen by a hash, whose content is marked up; none: the defaults hold."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{page}`").cast("string").alias("html")).where("html IS NOT NULL")
    total = rows.count()
    share = int(min(1.0, most / max(1, total)) * 1_000_000)
    chosen = rows.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < share).limit(2 * most)
    got = chosen.mapInArrow(_count, "feature string, inside bigint, outside bigint").groupBy("feature").agg(F.sum("inside"), F.sum("outside")).collect()
    return Weights({r[0]: (r[1], r[2]) for r in got})


def _extracted(batches: Iterator[pa.RecordBatch], weights: Weights, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [extract(p or "", weights) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()),
                                          pa.array([g[1] for g in got], pa.float64())], schema=schema)


def main_text(pages: DataFrame, weights: Weights, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row for each page: key, url, text, n_chars (code points) and the score of the chosen run.

    A null or empty page, or one without words, has an empty text and no characters. Whole pages are read, however long and
    however broken. Repeated rows and null keys are kept; other columns are not read. Nothing is shuffled."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{page}`").cast("string").alias("html"))
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = to_arrow_schema(rows.schema).field(0).type
    schema = pa.schema([("page_id", kind), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("score", pa.float64())])
    ddl = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint, score double"
    return rows.mapInArrow(partial(_extracted, weights=weights, schema=schema), ddl).withColumnRenamed("page_id", key)


__all__ = ["Weights", "best_run", "extract", "fit", "main_text", "parse"]
