"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element. A line's length is that of its text without link text; lines in menus,
headers, footers, sidebars, notices, adverts, forms and reader comments weigh nothing, and neither do those outside of the
article where the page marks one. Over the lengths of all lines of the page runs a window of WINDOW lines, from each line
on. A surge point is a line with text of its own whose window's sum exceeds the bar; the dive point is the next line whose
window's sum is nothing; lines from the surge to the dive are the main text, but for the kinds named. So a link amid
paragraphs stays, and runs of links part the text. The bar is a quarter of the page's largest sum, SURGE characters at most,
and a shorter line goes only if links alone stand on both of its sides. In a marked article the bar is nothing, so that its short
paragraphs stay wherever they stand, and link text is text but in list items, whose runs of links are menus.

An element that holds the article is never dropped, whatever its class; the end of an element ends those left open in it,
and one that is left open to the page's end drops nothing, unless it is a footer.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.common import text_or_empty

WINDOW = 3
SURGE = 80

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside form script style noscript template svg canvas iframe object button select textarea title xmp noembed noframes dialog menu header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark an element as not part of the article, and words that may stand beside them.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adsbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social comment comments disqus respond replies reviews sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar related recommended recommendations widget pagination pager skip search searchbox complementary contentinfo".split()
)
BESIDE = frozenset("area bar block bottom box buttons center container content desktop form global group holder icons inner item items left link links list main mobile outer page panel post posts primary right row secondary section site slot sticky thread top unit wrap wrapper".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


def _marks_chrome(token: str) -> bool:
    """A whole token such as footer, or one made of such words, numbers and those of BESIDE only, such as sidebar-right."""
    if token in CHROME:
        return True
    parts = _PARTS.split(token)
    return len(parts) > 1 and any(p in CHROME for p in parts) and all(p in CHROME or p in BESIDE or p.isdecimal() for p in parts)


def _is_chrome(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "style" and _UNSEEN.search(value):
            return True
        if key in ("class", "id", "role") and any(map(_marks_chrome, value.lower().split())):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, length without link text that may be a menu, counts as part of the page's text, stands in an article or main
    element) of each block, in page order."""
    raw: list[tuple[str, str, int]] = []
    text: list[str] = []
    link_text: list[str] = []
    names, parents, chrome = [""], [0], [False]  # of elements, each after its parent; 0 is the page
    stack = [0]
    open_names = Counter()

    def end_line() -> None:
        if text:
            raw.append(("".join(text), "".join(link_text), stack[-1]))
            text.clear()
            link_text.clear()

    def close(depth: int) -> None:
        open_names.subtract(names[e] for e in stack[depth:])
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None or m.end() == m.start():
            piece, at = page[at:], size
        else:
            piece, at = page[at : m.start()], m.end()
        if piece:
            text.append(piece)
            if open_names["a"]:
                link_text.append(piece)
        if m is None or m.end() == m.start() or m[2] is None:
            continue
        closing, name = bool(m[1]), m[2].lower()
        block = name in BLOCKS
        if name in RAW and not closing:
            end = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            if block:
                end_line()
            continue
        if block:
            end_line()
        elif name == "br":
            text.append(" ")
        if closing:
            for depth in range(len(stack) - 1, 0, -1) if open_names[name] else ():
                if names[stack[depth]] == name:
                    close(depth)
                    break
                if not block and names[stack[depth]] in BLOCKS:
                    break  # an inline end does not end a block
            continue
        if name in VOID or m[4]:
            continue
        if name in ("p", "a", "li") and name in (names[e] for e in stack[-3:]):  # these end an open one of their kind
            depth = max(d for d in range(len(stack)) if names[stack[d]] == name)
            if all(names[e] not in BLOCKS for e in stack[depth + 1 :]):
                close(depth)
        names.append(name)
        parents.append(stack[-1])
        chrome.append(_is_chrome(name, m[3]))
        stack.append(len(names) - 1)
        open_names[name] += 1
    end_line()
    for e in stack:  # what is left open to the page's end drops nothing, but for a footer
        chrome[e] = chrome[e] and names[e] == "footer"

    holds = [False] * len(names)
    for e, name in enumerate(names):
        if name in ("article", "main"):
            while e and not holds[e]:
                holds[e] = True
                e = parents[e]
    inside, listed, out = ([False] * len(names) for _ in range(3))
    for e in range(1, len(names)):
        up = parents[e]
        inside[e] = inside[up] or names[e] in ("article", "main")
        listed[e] = listed[up] or names[e] == "li"
        own_heading = names[e] == "header" and inside[up]
        out[e] = out[up] or chrome[e] and not holds[e] and not own_heading
    lines = []
    for words, linked, e in raw:
        line = _SPACE.sub(" ", html_lib.unescape(words)).strip()
        if line:
            own = len(line) - len(_SPACE.sub(" ", html_lib.unescape(linked)).strip()) if linked and (listed[e] or not inside[e]) else len(line)
            lines.append((line, max(0, own), not out[e], inside[e]))
    return lines


def between_surges(lengths: list[int], bar: float | None = None, window: int = WINDOW) -> list[bool]:
    """Which lines lie between a surge and its dive point of the window sums; without a bar, a quarter of the largest sum
    and SURGE at most."""
    keep = [False] * len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    if bar is None:
        bar = min(SURGE, max(sums, default=0) / 4)
    i = 0
    while i < len(sums):
        if not lengths[i] or sums[i] <= bar:
            i += 1
            continue
        while i < len(sums) and sums[i] > 0:
            keep[i] = True
            i += 1
    return keep


def beside_text(lengths: list[int], keep: list[bool]) -> list[bool]:
    """keep, and the other lines with text of their own but for those between lines of links on both sides."""
    last = len(lengths) - 1
    apart = lambda i: 0 < i < last and not lengths[i - 1] and not lengths[i + 1]
    return [k or n > 0 and not apart(i) for i, (n, k) in enumerate(zip(lengths, keep, strict=True))]


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by one newline; '' if the page has none."""
    lines = page_lines(page or "")
    marked = any(counts and inside for _, _, counts, inside in lines)
    whole = [own if counts and (inside or not marked) else 0 for _, own, counts, inside in lines]
    keep = between_surges(whole, 0 if marked else None)
    shown = [(line[0], own, k) for line, own, k in zip(lines, whole, keep, strict=True) if line[2] and (line[3] or not marked)]
    if not marked:
        stay = beside_text([own for _, own, _ in shown], [k for _, _, k in shown])
        shown = [(text, own, s) for (text, own, _), s in zip(shown, stay, strict=True)]
    return "\n".join(text for text, _, k in shown if k)


def extract_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """df without its html, with text (replaced if present). Null and empty html gives ''; rows are independent of one
    another, pages may have any length, and an empty table gives an empty one."""
    others = [c for c in df.columns if c not in (html, "text")]
    picked = df.select(*[F.col(f"`{c}`") for c in others], text_or_empty(html).alias("text"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], batch.schema.names)

    return picked.mapInArrow(run, picked.schema)


def op9_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
