"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of text runs and tags. Words score by the context they stand in, tags score negative; the weights
are log-odds learned from pages that label their content themselves (with an article or main element). One linear scan
finds the contiguous region of the highest sum, which is the content; menus, adverts and the like inside it are left out.

Names of classes say what is a menu or an advert, but pages also wrap their whole content in a form, a widget or a notice.
Such a name counts for nothing where the element holds the page's article, or without one at least half of its words.
Time and memory are linear in the page, however long or deep it is. Repeated rows have equal results.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import python_workers, table

#: Labelled pages that the weights are learned from, at most about this many.
SAMPLE_PAGES = 2_000

# Elements by what they are for.
_HIDDEN = frozenset("head title script style noscript template textarea select option button iframe object svg canvas audio video datalist".split())
_RAW = frozenset("script style textarea title template noscript iframe svg".split())
_FURNITURE = frozenset("nav footer aside form menu dialog label input fieldset".split())
_CONTENT = frozenset("article main".split())
_BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul""".split()
)
_SPACING = frozenset("br td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_PARAGRAPH = _BLOCKS - frozenset("html body".split())
_SECTIONS = frozenset("nav header footer aside form section menu".split())
_REMARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising comment comments disqus promo promoted replies reply respond
    sponsor sponsored""".split()
)
_MARKS = _REMARKS | frozenset(
    """breadcrumb breadcrumbs consent cookie cookies copyright footer masthead menu nav navbar navigation newsletter pager
    pagination recommended related sidebar signup skip subscribe toolbar complementary contentinfo""".split()
)
#: Names that also wrap whole pages.
_WRAPPERS = frozenset("banner login modal notice notification popup share sharing social widget widgets".split())
#: What goes with such names in a compound one: "sidebar-left" is a sidebar, "has-sidebar" isn't.
_COMPANIONS = frozenset(
    """area bar block bottom box button buttons container form global group header icons inner item items left link links
    list main page panel posts primary right secondary section site slot top unit wrap wrapper zone""".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_MARKED = (_BLOCKS | frozenset("td th".split())) - frozenset("html body hgroup h1 h2 h3 h4 h5 h6".split())
#: An attribute's name and value; values are consumed whole, so that nothing in them is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Item:
    """A text run or a tag of a page."""

    text: str | None  # None: a tag
    key: str  # context of a run, name of a tag
    furniture: bool  # stands in something that isn't content by its name
    inside: bool  # stands in an element that labels the content
    breaks: int = 0  # of a tag: 2 ends a block, 1 is a space
    words: int = 0  # of a run


@dataclass(slots=True)
class _Mark:
    """An element that attributes call furniture, or a form, until it is known what it holds."""

    parent: _Mark | None
    certain: bool  # its name is no wrapper's, nor that of a mark around it
    section: str | _Mark  # its own, for the words in it
    outer: str | _Mark  # the section around it
    words: int = 0
    withdrawn: bool = False
    furniture: bool = False  # this one stands, or one around it


@dataclass(slots=True)
class _Open:
    name: str
    hidden: bool
    furniture: bool
    inside: bool
    section: str | _Mark  # a mark stands for the section it makes
    block: str
    mark: _Mark | None = None


def _named(value: str) -> frozenset[str]:
    """Which names of furniture a class, id or role consists of: itself, or its parts if the others are companions."""
    parts = frozenset(re.findall(r"[^-_0-9]+", value))
    names = parts & (_MARKS | _WRAPPERS)
    return names if names and parts <= names | _COMPANIONS else frozenset()


def _marks(name: str, rest: str) -> tuple[bool, bool, bool, bool, str]:
    """What an element's attributes say: that it is furniture, that this is certain, that it is an advert or a remark, that
    it is the content; and the first part of its class.

    Classes, ids and roles of containers speak for furniture; ``hidden`` does on any element below the body.
    """
    furniture = certain = remark = content = False
    first = ""
    for key, *values in _ATTRIBUTE.findall(rest) if rest else ():
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden" and name not in ("html", "body"):
            furniture = certain = True
        elif key in ("class", "id", "role"):
            if name in _MARKED:
                named = frozenset().union(*map(_named, value.split()))
                furniture |= bool(named)
                certain |= not named <= _WRAPPERS or bool(named) and key == "role"
                remark |= not named.isdisjoint(_REMARKS)
            content |= key == "role" and value == "main"
            if key == "class" and not first:
                first = next(iter(re.findall(r"[a-z0-9]+", value)), "")
        elif key == "itemprop":
            content |= value == "articlebody"
    return furniture, certain, remark, content, first


def _judge(marks: list[_Mark], mains: list[_Mark | None], articles: list[_Mark | None], words: int) -> None:
    """Withdraw the marks that hold the page's content, then settle the others. Marks stand before those inside them.

    ``mains`` and ``articles`` are the innermost marks around what is certainly the content and around articles. Several
    articles are teasers as often as not; a single one is the page's. Where neither tells, it is the ``words``: those of the
    page outside of certain furniture.
    """
    around = mains or (articles if len(articles) == 1 else [])
    for mark in around:
        while mark is not None and not mark.withdrawn:
            mark.withdrawn = True
            mark = mark.parent
    for mark in reversed(marks):
        if not around and not mark.certain:
            mark.withdrawn = 2 * mark.words >= words
        if mark.parent is not None:
            mark.parent.words += mark.words
    for mark in marks:
        mark.furniture = not mark.withdrawn or mark.parent is not None and mark.parent.furniture
        outer = mark.outer.section if isinstance(mark.outer, _Mark) else mark.outer
        mark.section = outer if mark.withdrawn else mark.section


def parse(page: str | None) -> list[Item]:
    """Runs and tags of a page in order, without what is never shown. Any text parses; a cut-off tag at the end is dropped."""
    page = page or ""
    items: list[Item] = []
    under: list[_Open] = []  # of each item
    marks: list[_Mark] = []
    mains: list[_Mark | None] = []
    articles: list[_Mark | None] = []
    total = 0
    stack = [_Open("", False, False, False, "", "body")]
    places: dict[str, list[int]] = {}  # of the open elements of a name
    blocks: list[int] = []  # of the open blocks

    def last(*names: str) -> int:
        """Place of the innermost open element of these names, or 0."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def run(text: str) -> None:
        nonlocal total
        top = stack[-1]
        if text and not top.hidden:
            text = html.unescape(text)
            items.append(Item(text, "", top.furniture, top.inside, 0, len(text.split())))
            under.append(top)
            if not top.furniture and not (top.mark and top.mark.certain):
                total += items[-1].words
                if top.mark:
                    top.mark.words += items[-1].words

    def tag(name: str, breaks: int, top: _Open) -> None:
        if not top.hidden:
            items.append(Item(None, name, top.furniture, top.inside, breaks))
            under.append(top)

    def close(k: int) -> None:
        for _ in range(len(stack) - k):
            top = stack.pop()
            places[top.name].pop()
            if top.name in _BLOCKS:
                blocks.pop()
            tag("/" + top.name, 2 if top.name in _BLOCKS else int(top.name in _SPACING), top)

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            run(page[at:])
            break
        run(page[at : found.start()])
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if page[at - 1] != ">":
            break  # a tag that the page's end cuts off
        rest = found["rest"] or found["rest2"] or ""
        if found["close"] or found["close2"]:
            if k := last(name):
                close(k)
            elif name in ("p", "br"):
                tag(name, 2 if name == "p" else 1, stack[-1])
            continue
        if name in _RAW and not rest.endswith("/"):
            closing = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = closing.end() if closing else end
            continue
        if name in _ENDS_PARAGRAPH and blocks and stack[blocks[-1]].name == "p":
            close(blocks[-1])
        if name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            k = last(*same, "ul", "ol", "menu", "table", "dl", "select")
            if k and stack[k].name in same:
                close(k)
        top = stack[-1]
        marked, certain, remark, content, first = _marks(name, rest)
        article = name == "article" and not remark
        if content or name == "main":
            mains.append(top.mark)
        elif article and not top.inside:
            articles.append(top.mark)
        content |= article or name == "main"
        furniture = (name in _FURNITURE and name != "form") or (name == "header" and not top.inside)
        section = f"{name}.{first}" if first else name if name in _SECTIONS else top.section
        mark = top.mark
        if (marked or name == "form") and not content:
            mark = _Mark(top.mark, certain or bool(top.mark and top.mark.certain), section, top.section)
            marks.append(mark)
            section = mark
        opened = _Open(
            name,
            top.hidden or name in _HIDDEN,
            top.furniture or furniture and not content,
            top.inside or content,
            top.section if content else section,
            "body" if content else name if name in _BLOCKS else top.block,
            mark,
        )
        tag(name, 2 if name in _BLOCKS else int(name in _SPACING), opened)
        if name not in _VOID and not rest.endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if name in _BLOCKS:
                blocks.append(len(stack))
            stack.append(opened)
    _judge(marks, mains, articles, total)
    for item, top in zip(items, under, strict=True):
        item.furniture |= top.mark is not None and top.mark.furniture
        if item.text is not None:
            item.key = f"{top.section.section if isinstance(top.section, _Mark) else top.section} {top.block}"
    return items


def labelled(items: list[Item]) -> bool:
    return any(i.inside for i in items) and any(not i.inside for i in items)


def counted(items: list[Item]) -> Counter:
    """Words by context and tags by name, inside and outside the labelled content."""
    counts: Counter = Counter()
    for item in items:
        content = item.inside and not item.furniture
        if item.text is None:
            if item.key.lstrip("/") not in _CONTENT:
                counts["tag", item.key, content] += 1
        else:
            counts["word", item.key, content] += item.words
    return counts


def weights(counts: dict[tuple[str, str, bool], int]) -> dict[tuple[str, str], float]:
    """Log-odds of being content: of words from -3 to 1.5, of tags from -3 to just below 0."""
    out = {}
    for kind, key in {(k[0], k[1]) for k in counts}:
        odds = math.log((counts.get((kind, key, True), 0) + 1) / (counts.get((kind, key, False), 0) + 1))
        out[kind, key] = max(-3.0, min(1.5, odds)) if kind == "word" else max(-3.0, min(-0.05, odds - 3.0))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous region of the highest sum, the first of equals; (0, 0) if none is above zero."""
    best, low, high = 0.0, 0, 0
    total, begin = 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += score
        if total > best:
            best, low, high = total, begin, k + 1
    return low, high


def extract(items: list[Item], learned: dict[tuple[str, str], float]) -> str:
    """The blocks of the best region, joined by an empty line; without words, an empty text."""
    scores, keep = [], []
    for item in items:
        if item.text is None:
            keep.append(False)
            scores.append(0.0 if item.inside and item.furniture else learned.get(("tag", item.key), -0.05))
        else:
            known = learned.get(("word", item.key), 1.0)
            keep.append(not item.furniture and (known > 0 or item.inside))
            # Furniture is left out in any case; so that it does not tear a region apart, its words count little, and
            # nothing inside the labelled content. It is the tags that part regions.
            weight = max(known, 0.25) if keep[-1] else 0.0 if item.inside else -0.25
            scores.append(weight * item.words)
    low, high = best_region(scores)
    blocks: list[list[str]] = [[]]
    for k in range(low, high):
        item = items[k]
        if item.text is None:
            if item.breaks == 2:
                blocks.append([])
            elif item.breaks == 1:
                blocks[-1].append(" ")
        elif keep[k]:
            blocks[-1].append(item.text)
    return "\n\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def learn(pages: DataFrame, column: str = "html", key: str = "page_id") -> dict[tuple[str, str], float]:
    """Weights from a sample of the labelled pages, drawn by a hash of key and length.

    The labelled pages are counted first, so the sample is bounded whatever their number. Without any, the weights are
    empty and the names of the elements alone decide.
    """
    python_workers(pages.sparkSession)
    signs = r"(?i)<(article|main)\b|role=.main\b|itemprop=.articlebody"
    signed = pages.where(F.col(column).rlike(signs))
    share = SAMPLE_PAGES / max(1, signed.count())
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.length(column)), F.lit(1 << 30)) < share * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                items = parse(page)
                if labelled(items):
                    counts += counted(items)
        kinds, keys, contents = ([k[n] for k in counts] for n in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(contents, pa.bool_()), pa.array(counts.values(), pa.int64())],
            names=["kind", "key", "content", "n"],
        )

    counts = signed.where(drawn).select(column).mapInArrow(count, "kind string, key string, content boolean, n long")
    summed = counts.groupBy("kind", "key", "content").agg(F.sum("n").alias("n"))
    return weights({(r["kind"], r["key"], r["content"]): r["n"] for r in summed.collect()})


def main_text(pages: DataFrame, learned: dict[tuple[str, str], float], column: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``carry`` and ``text``, empty for a null or empty page. Nothing is shuffled."""
    spark = pages.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(parse(p), shared.value) for p in batch.column("extracted_page").to_pylist()]
            kept = [n for n in batch.schema.names if n != "extracted_page"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array(texts, pa.string())], names=[*kept, "text"]
            )

    given = pages.select(*carry, F.col(column).alias("extracted_page"))
    return given.mapInArrow(run, given.drop("extracted_page").schema.add("text", "string"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, learn(pages)).withColumn("n_chars", F.length("text").cast("long"))
