"""Operator 5, HTML extraction by tag-path ratios.

Each page becomes a list of text blocks with their root-to-leaf tag paths. For every path the text's length and its punctuation
are summed and divided by the path's blocks; both ratios, smoothed over the page's order and fused by multiplication, score the
blocks; those over a threshold from the scores' spread are content. The nearest article, main or other container of all the
content is the article, and all of its blocks are its text, short paragraphs and headings too. Elements that are never
part of an article (menus, page headers and footers, sidebars, forms, scripts, and those whose class, id or role says notice, advert,
comments and the like) are left out first, but not a form or named element that holds the article itself.

Null html is empty; a page without text gives an empty string. Very long and unclosed markup is read to its end, in linear time.
Repeated rows give repeated results, a null page_id or url stays null, an empty table gives an empty one, and other columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form menu dialog fieldset object audio video canvas head title button select svg noscript template".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: What a name may start with before one of WORDS, and what makes a name one of layout or state.
BEFORE = frozenset("site page left right top bottom global main primary secondary post article user entry social".split())
LAYOUT = frozenset("no not non without with has is hide hidden layout open enabled disabled visible active content container page body".split())
#: Open elements that a start tag ends, and those beyond which none is looked for.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",)}
P_STOPS = ("td", "th", "li", "table", "div", "section", "article", "blockquote")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("title meta link base basefont bgsound noscript template".split())
SKIPPED = frozenset("button select svg noscript template".split())
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
CLOSING = re.compile(r"</(button|select|svg|noscript|template)\b", re.I)
NONE = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、；：！？]")
HOMES = ("article", "main")


def _named(name: str) -> bool:
    """Whether a class or id as a whole, or by a known beginning, says that it isn't of the article."""
    tokens = [t for t in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if t]
    if not tokens or LAYOUT.intersection(tokens[1:] if tokens[0] in BEFORE else tokens):
        return False
    if tokens[0] in WORDS:
        return True
    if tokens[0] not in BEFORE or len(tokens) < 2 or tokens[1] not in WORDS:
        return False
    return not (tokens[1] in ("header", "masthead") and tokens[0] in ("main", "post", "article", "entry", "page"))


def _leave_out(tag: str, attributes: str, at_home: bool) -> int:
    """2: never part of an article; 1: said to be none, by its name or as a form; 0: may be."""
    has: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        has.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    if "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true" or NONE.search(has.get("style", "")):
        return 2
    if tag in ("form", "fieldset"):
        return 1
    if tag in NEVER or tag == "header" and not at_home:
        return 2
    if tag in ("html", "body", *HOMES, *HEADINGS):
        return 0
    if ROLES.intersection(has.get("role", "").lower().split()) or any(map(_named, [*has.get("class", "").split(), has.get("id", "")])):
        return 1 if tag in BLOCKS or "-" in tag else 2
    return 0


class Tree:
    """The page's block elements, numbered as they open; 0 stands for the page. An element's descendants have the numbers up to last."""

    def __init__(self):
        self.parent, self.tag, self.kind = [0], [""], [0]
        self.kinds: dict[tuple[int, str], int] = {}  # tag paths, by the path above and the tag

    def add(self, parent: int, tag: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.kind.append(self.kinds.setdefault((self.kind[parent], tag), 1 + len(self.kinds)))
        return len(self.parent) - 1

    def up(self, node: int) -> Iterator[int]:
        while node:
            yield node
            node = self.parent[node]

    def shared(self, low: int, high: int) -> int:
        """The deepest element with both in it; with the least and the greatest of some elements, the one with them all."""
        above = {*self.up(low)}
        return next((n for n in self.up(high) if n in above), 0)

    def last(self, node: int) -> int:
        """The greatest number in it."""
        inside = node
        for n in range(node + 1, len(self.parent)):
            if not node <= self.parent[n] <= inside:
                break
            inside = n
        return inside if node else len(self.parent) - 1


def blocks(page: str) -> tuple[Tree, list[tuple[int, str]]]:
    """The tree, and (element, text) of every block that could be content, in page order, in time linear in the page.

    An element that is left out only for its name or as a form stays where no article or main lies outside of such elements and it holds a
    fourth of the page's text with an article or main in it, or over half of the text.
    """
    tree, out, held, skip, at = Tree(), [], [], 0, 0
    opened: list[tuple[str, int, int, int]] = []  # tag, block element, element that is left out by name, how it is left out
    count: Counter[str] = Counter()
    said, homes = [0], []  # of the elements that are left out by name, the one around each; those around an article or main
    ends_at = {m[1].lower(): m.start() for m in CLOSING.finditer(page)}

    def flush():
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                out.append((opened[-1][1] if opened else 0, text, opened[-1][2] if opened else 0))
            held.clear()

    def leave(k: int):
        """Close the element at place k of the path and all within it."""
        nonlocal skip
        if any(t in BLOCKS or s == 1 for t, _, _, s in opened[k:]):
            flush()
        for t, _, _, s in opened[k:]:
            count[t] -= 1
            skip -= s == 2
        del opened[k:]

    def lowest(tags) -> int | None:
        """Place of the outermost open element of tags."""
        return next(k for k, x in enumerate(opened) if x[0] in tags) if any(count[t] for t in tags) else None

    for m in TOKEN.finditer(page):
        if m.start() > at:
            if opened and opened[-1][0] == "head" and not page[at : m.start()].isspace():
                leave(len(opened) - 1)
            if not skip:
                held.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if count[tag]:
                leave(next(k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == tag))
            continue
        if tag not in IN_HEAD and (k := lowest(("head", "title"))) is not None:
            leave(k)  # the head ends where the body's first element is, with or without a tag
        over = ("button", "select", "svg") if tag in BLOCKS and tag != "hr" and not count["foreignobject"] else (tag,) if tag in ("button", "select") else ()
        if over and (k := lowest(over)) is not None:
            leave(k)
        if tag == "br":
            if not skip:
                held.append(" ")
            continue
        ends = ("p",) if tag in CLOSES_P else ENDS.get(tag, ())
        if any(count[t] for t in ends):
            stop = STOPS.get(tag, P_STOPS)
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] in stop:
                    break
                if opened[k][0] in ends:
                    leave(k)
                    break
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        out_of = _leave_out(tag, m[4], any(count[h] for h in HOMES))
        if tag in SKIPPED and ends_at.get(tag, -1) < at:  # never closed
            out_of = 0
        node, name = opened[-1][1:3] if opened else (0, 0)
        if out_of == 1:
            flush()
            said.append(name)
            name = len(said) - 1
        if tag in HOMES and not skip:
            homes.append(name)
        opened.append((tag, tree.add(node, tag) if tag in BLOCKS else node, name, out_of))
        count[tag] += 1
        skip += out_of == 2
    if at < len(page):
        if opened and opened[-1][0] == "head" and not page[at:].isspace():
            leave(len(opened) - 1)
        if not skip:
            held.append(page[at:])
    flush()
    stays = [True] + [False] * (len(said) - 1)
    if 0 not in homes:
        size, around = [0] * len(said), [False] * len(said)
        for _, t, name in out:
            size[name] += len(t)
        for name in homes:
            around[name] = True
        total = sum(size)
        for x in range(len(said) - 1, 0, -1):  # from within
            size[said[x]] += size[x]
            around[said[x]] |= around[x]
        for x in range(1, len(said)):
            stays[x] = stays[said[x]] and (2 * size[x] > total or around[x] and 4 * size[x] >= total)
    return tree, [(node, t) for node, t, name in out if stays[name]]


def main_text(page: str | None) -> str:
    tree, found = blocks(page or "")
    if not found:
        return ""
    place = np.unique([tree.kind[n] for n, _ in found], return_inverse=True)[1]
    n = np.bincount(place)
    length = np.bincount(place, [len(t) for _, t in found]) / n
    marks = np.bincount(place, [len(PUNCTUATION.findall(t)) for _, t in found]) / n
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid")
    fused = smooth(length[place]) * (1 + smooth(marks[place]))
    content = fused >= min(fused.std(), fused.mean()) if len(fused) > 1 else np.array([True])
    # the deepest element with all of the content, then the article, main or other container that it's in
    nodes = [node for (node, _), c in zip(found, content) if c]
    best = list(tree.up(tree.shared(min(nodes), max(nodes))))
    home = next((x for x in best if tree.tag[x] in HOMES), None)
    if home is None:
        home = next((x for x in best if tree.tag[x] in ("section", "div", "td", "body", "html")), 0)
    last = tree.last(home)
    return "\n".join(t for node, t in found if home <= node <= last)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                texts = [main_text(h) for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=SCHEMA)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
