"""Main text of web pages: the best-scoring contiguous stretch of words and tags.

A page is a sequence of words and tags. Words in surroundings that articles have score positive, words in surroundings of
menus, adverts and the like negative, tags negative by how often they stand outside of articles. One linear scan finds the
stretch of the highest sum; its blocks, without the parts whose markup names them menus, forms, comments and so on, are the
text. The weights are learned from labelled pages: pages that mark their article themselves with one ``article`` (or
``main``) element label their own words as inside or outside. The weights of surroundings are a logistic regression over
block element, link, named part and the page's own mark; the mark is hidden in a second copy of every labelled page, so that
unmarked pages are scored by the rest.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.registry import query, table

#: About so many pages, drawn by a share of hashes, are looked at for labels.
SAMPLE_PAGES = 2000
#: Words that a tag costs if it stands outside of articles only.
TAG_COST = 2.0
#: Share of a tag's places outside of articles where no labelled page has it outside of named parts.
TAG_PRIOR = 0.1
#: Bound of the score of one word.
CLIP = 4.0

# Elements and names of HTML and of common page templates.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Not kept open: they neither break a block nor change what a word belongs to.
PLAIN = frozenset("abbr b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp small strike strong sub sup time tt u var".split())
#: Their content is no markup and is skipped up to the end tag.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset("audio canvas datalist head noscript object select svg template video".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main"
    " menu nav ol p pre search section summary table ul".split()
)
#: Opening the key ends an open one of the first names unless one of the second stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
}
TAG_PARTS = {
    "nav": "menu",
    "menu": "menu",
    "header": "header",
    "footer": "footer",
    "aside": "sidebar",
    "dialog": "notice",
    "form": "form",
    "button": "form",
    "fieldset": "form",
    "label": "form",
    "output": "form",
    "search": "form",
}
PART_WORDS = {
    "menu": "breadcrumb breadcrumbs menu menubar nav navbar navigation pager pagination tabs toc topnav",
    "header": "header masthead topbar",
    "footer": "colophon copyright footer",
    "sidebar": "aside complementary recommended related rail sidebar sidenav trending widget widgets",
    "notice": "alert banner consent cookie cookies gdpr modal newsletter notice notification overlay paywall popup signup subscribe toast",
    "advert": "ad ads adsense advert advertisement advertising advertorial adverts adslot doubleclick promo promoted promotion sponsor sponsored sponsors",
    "comment": "comment comments commentlist discussion disqus replies reply respond",
    "form": "form login search searchbox",
    "share": "follow share sharing social",
    "hidden": "hidden",
}
PART_OF = {w: part for part, words in PART_WORDS.items() for w in words.split()}
PARTS = (*PART_WORDS, "unseen")
#: A name that holds one of these says what the page has, not what the element is.
OF_PAGE = frozenset("has no with without".split())
#: A header named after these is the head of the article itself.
OF_ARTICLE = frozenset("article content entry post story".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)",
    re.DOTALL,
)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)(?![^\s=/])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ARTICLE = re.compile(r"<article(?=[\s/>])", re.I)


def part_of(name: str, rest: str) -> str | None:
    """Part of a page that an element's own markup says it is; None for content."""
    if name in UNSEEN:
        return "unseen"
    if name in TAG_PARTS:
        return TAG_PARTS[name]
    if not rest:
        return None
    found = None
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "hidden"
        if key in ("class", "id", "role", "aria-label") and name not in ("html", "body"):
            for one in value.split():
                words = [w.lower() for w in _NAME.findall(one)]
                part = next((PART_OF[w] for w in words if w in PART_OF), None)
                if not OF_PAGE.intersection(words) and not (part == "header" and OF_ARTICLE.intersection(words)):
                    found = found or part
    return None if name == "main" else found


def _marks(name: str, rest: str, by: str | None) -> bool:
    return name == by or by == "main" and bool(rest) and bool(re.search(r"(?:role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articleBody)\b", rest, re.I))


@dataclass
class Page:
    """Words and tags of a page in order.

    ``runs`` holds (block number, block element, in a link, part, inside the page's mark, raw text, words) or, for a tag,
    (its name, part, inside the page's mark). ``marks``: how many elements mark the article; the mark is None if there are none.
    """

    runs: list[tuple]
    marks: int

    @property
    def labelled(self) -> bool:
        return self.marks == 1


def read_page(source: str) -> Page:
    """Events of the page in one pass; wrong nesting, open ends and stray tags are taken as browsers do, roughly."""
    # articles that are named comments or adverts mark nothing
    by = "article" if any(part_of("article", _TAG.match(source, m.start())["rest"]) is None for m in _ARTICLE.finditer(source)) else "main"
    runs: list[tuple] = []
    stack: list[tuple] = []  # (name, part, is a block, marks)
    where: dict[str, list[int]] = {}
    parts: list[str] = []
    blocks = ["body"]
    block, marked, marks, link, at, size = 0, 0, 0, -1, 0, len(source)

    def close(to: int) -> None:
        nonlocal marked, link
        while len(stack) > to:
            name, part, is_block, is_mark = stack.pop()
            where[name].pop()
            if part is not None:
                parts.pop()
            if is_block:
                blocks.pop()
            marked -= is_mark
        if link > to:
            link = -1

    def last(*names: str) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def text(upto: int) -> None:
        if upto > at:
            piece = source[at:upto]
            words = len(entities.unescape(piece).split()) if "&" in piece else len(piece.split())
            runs.append((block, blocks[-1], link >= 0, parts[-1] if parts else None, marked > 0, piece, words))

    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            text(size)
            break
        text(m.start())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        is_block = name in BLOCKS
        if is_block:
            block += 1
        if name == "br":
            runs.append((block, blocks[-1], link >= 0, parts[-1] if parts else None, marked > 0, " ", 0))
        if m["end"]:
            if name == "a":
                link = -1
            runs.append((name, parts[-1] if parts else None, marked > 0))
            if where.get(name):
                close(where[name][-1])
            continue
        rest = m["rest"]
        if where.get("head") and name not in IN_HEAD:
            close(where["head"][0])
        if name in ENDS_P and where.get("p"):
            close(where["p"][-1])
        if name in ENDS:
            own, between = ENDS[name]
            if last(*own) > last(*between):
                close(last(*own))
        is_mark = _marks(name, rest, by)
        part = part_of(name, rest)
        if part == "header" and marked:
            part = None  # an article's own header holds its title
        is_mark = is_mark and part is None
        marks += is_mark and not marked
        if not is_mark:
            runs.append((name, parts[-1] if parts else None, marked > 0))
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            at = size if end is None else end.start()
        elif name not in VOID and name not in PLAIN:
            where.setdefault(name, []).append(len(stack))
            stack.append((name, part, is_block, is_mark))
            if name == "a":
                link = len(stack)
            if part is not None:
                parts.append(part)
            if is_block:
                blocks.append(name)
            marked += is_mark
    return Page(runs, marks)


BLOCK_NAMES = sorted(BLOCKS)
_COLUMN = {("block", b): 1 + k for k, b in enumerate(BLOCK_NAMES)}
_COLUMN |= {("part", p): len(_COLUMN) + 1 + k for k, p in enumerate(PARTS)}
_COLUMN |= {("more", m): len(_COLUMN) + 1 + k for k, m in enumerate(("link", "inside", "outside"))}


def _row(block: str, link: bool, part: str | None, mark: str) -> list[int]:
    """Columns that are 1, beside the constant 0, for a word's surroundings."""
    out = [0, _COLUMN["block", block]]
    if link:
        out.append(_COLUMN["more", "link"])
    if part is not None:
        out.append(_COLUMN["part", part])
    if mark:
        out.append(_COLUMN["more", mark])
    return out


def label_counts(pages: DataFrame, source: str = "html") -> dict[tuple, tuple[int, int]]:
    """{(kind, name, link, part, mark): (inside, outside)} of the words and tags of labelled pages; at most a few thousand keys."""

    def run(batches):
        total: dict[tuple, list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                page = read_page(text or "")
                if not page.labelled:
                    continue
                for r in page.runs:
                    if len(r) == 3:
                        key, inside, n = ("tag", r[0][:20], False, r[1] or "", "inside" if r[2] else "outside"), r[2] and r[1] is None, 1
                    else:
                        key, inside, n = ("word", r[1], r[2], r[3] or "", "inside" if r[4] else "outside"), r[4] and r[3] is None, r[6]
                    at = total.setdefault(key, [0, 0])
                    at[not inside] += n
            if len(total) > 100_000:  # tag names are free text
                yield _counts_batch(total)
                total = {}
        if total:
            yield _counts_batch(total)

    found = pages.select(source).mapInArrow(run, "kind string, name string, link boolean, part string, mark string, inside long, outside long")
    summed = found.where(F.col("kind").eqNullSafe("word") | F.col("name").isin(sorted(KNOWN_TAGS))).groupBy("kind", "name", "link", "part", "mark")
    return {tuple(r)[:5]: (r["i"], r["o"]) for r in summed.agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()}


def _counts_batch(total: dict) -> pa.RecordBatch:
    keys = list(total)
    columns = [pa.array([k[c] for k in keys]) for c in range(5)] + [pa.array([total[k][c] for k in keys], pa.int64()) for c in range(2)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "name", "link", "part", "mark", "inside", "outside"])


KNOWN_TAGS = BLOCKS | VOID | PLAIN | RAW | UNSEEN | {"a", "button", "label", "output", "span"}


@dataclass(frozen=True)
class Weights:
    """Score of a word in its surroundings, and what a tag costs."""

    word: np.ndarray
    tag: dict[tuple[str, str], float]

    def of_word(self, block: str, link: bool, part: str | None, mark: str) -> float:
        return float(np.clip(self.word[_row(block, link, part, mark)].sum(), -CLIP, CLIP))

    def of_tag(self, name: str, part: str | None, mark: str) -> float:
        if part is not None:
            return -TAG_COST
        return self.tag.get((name, mark), -TAG_COST * {"inside": 0.0, "outside": 1.0}.get(mark, TAG_PRIOR))


def fit(counts: dict[tuple, tuple[int, int]], steps: int = 30, ridge: float = 1.0) -> Weights:
    """Weights from the counts; a few words of prior belief (paragraphs and headings are inside, named parts and linked list
    items outside) decide where no labelled page does."""
    rows: dict[tuple, list[float]] = {}

    def add(block, link, part, mark, inside, outside):
        at = rows.setdefault((block, link, part, mark), [0.0, 0.0])
        at[0] += inside
        at[1] += outside

    words = sum(i + o for k, (i, o) in counts.items() if k[0] == "word") or 1
    for (kind, name, link, part, mark), (i, o) in counts.items():
        if kind == "word":
            for m in (mark, ""):
                add(name, link, part or None, m, i * 1000 / words, o * 1000 / words)
    for block in ("p", "h1", "h2", "h3", "blockquote", "pre", "div", "article"):
        add(block, False, None, "", 10, 0)
        add(block, False, None, "inside", 5, 0)
        add(block, False, None, "outside", 0, 5)
    add("li", False, None, "", 2, 0)
    add("li", True, None, "", 0, 10)
    for part in PARTS:
        for mark in ("", "inside", "outside"):
            add("p", False, part, mark, 0, 20)
    x = np.zeros((len(rows), len(_COLUMN) + 1))
    for k, key in enumerate(rows):
        x[k, _row(*key)] = 1
    n = np.array(list(rows.values()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n[:, 0] - n.sum(1) * p) - ridge * w
        bend = (x * (n.sum(1) * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    tags: dict[tuple[str, str], list[int]] = {}
    for (kind, name, _, part, mark), (i, o) in counts.items():
        if kind == "tag" and not part:  # tags of named parts tell nothing of the same tags elsewhere
            for m in (mark, ""):
                at = tags.setdefault((name, m), [0, 0])
                at[0] += i
                at[1] += o
    tag = {k: -TAG_COST * (o + TAG_PRIOR * (k[1] == "")) / (i + o + (k[1] == "")) for k, (i, o) in tags.items()}
    return Weights(w, tag)


def train(pages: DataFrame, key: tuple[str, ...] = ("page_id", "url"), source: str = "html", rows: int = SAMPLE_PAGES) -> Weights:
    """Weights from the labelled ones of about ``rows`` pages, the same in every run. Only counts leave the tasks."""
    total, every = pages.count(), 1 << 30
    take = min(every, -(-every * rows // max(total, 1)))
    return fit(label_counts(pages.where(F.pmod(F.xxhash64(*key), F.lit(every)) < take), source))


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous stretch of the highest sum, the first of equal ones; empty if no score is positive."""
    best, start, end, total, first = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, k
        total += s
        if total > best:
            best, start, end = total, first, k + 1
    return start, end


def main_text(source: str, weights: Weights, known: dict | None = None) -> str:
    """Text of the page's article; ``known`` keeps scores of surroundings between pages.

    However long an advert is, it may stand between two paragraphs: a named part takes ``CLIP`` at most, within the page's
    mark nothing.
    """
    page = read_page(source)
    known = {} if known is None else known
    scores, spent = [], 0.0
    for r in page.runs:
        mark = ("inside" if r[-1 if len(r) == 3 else 4] else "outside") if page.marks else ""
        part = r[1 if len(r) == 3 else 3]
        if part is not None and mark == "inside":
            scores.append(0.0)  # left out where it stands
            continue
        if len(r) == 3:
            score = weights.of_tag(r[0], part, mark)
        else:
            key = (r[1], r[2], part, mark)
            if key not in known:
                known[key] = weights.of_word(*key)
            score = r[6] * known[key]
        if part is None:
            spent = 0.0
        else:
            score = max(score, -CLIP - spent)
            spent += score
        scores.append(score)
    start, end = best_stretch(scores)
    inside = lambda r: len(r) > 3 and r[3] is None and (r[4] or not page.marks)
    kept = [r[0] for r in page.runs[start:end] if inside(r) and r[6]]
    if not kept:
        return ""
    low, high = kept[0], kept[-1]
    blocks: dict[int, list[str]] = {}
    for r in page.runs:
        if inside(r) and low <= r[0] <= high:
            blocks.setdefault(r[0], []).append(r[5])
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, weights: Weights, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row.

    Null and empty pages, and pages without an article, have an empty text of 0 characters. Pages are read whole, however
    long, in time linear in their length; repeated rows are rows each. Empty tables give no rows; other columns are ignored.
    Character references are decoded once; white space inside a block, line breaks included, is one space.
    """
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        known: dict = {}
        for batch in batches:
            texts, upto = [], 0
            for k, text in enumerate(batch.column(2)):
                texts.append(main_text(text.as_py() or "", sent.value, known))
                if k + 1 - upto == 256 or k + 1 == batch.num_rows:
                    rows = batch.slice(upto, k + 1 - upto)
                    n = pa.array([len(t) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), n], [key, url, "text", "n_chars"])
                    texts, upto = [], k + 1

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select(key, url, source).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")


@query("op12_html_extract")
def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
