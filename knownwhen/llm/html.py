"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text. Each piece of text belongs to its root-to-leaf path of tags. Text length and
punctuation are summed per path and divided by the number of text nodes there; both ratios are smoothed along the page,
fused, and compared with a threshold drawn from their own spread. Text under elements that HTML or their own names mark
as something else (navigation, footers, forms, adverts, comments ...) never counts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, query, slices

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
FOREIGN = frozenset("nav header footer aside form button select option dialog menu head label fieldset iframe object audio video canvas".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "option", "optgroup", "legend", "caption"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark other matter.
OTHER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promoted sponsor sponsored sponsors nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer foot sidebar aside side widget widgets related recommended recommendations share sharing social comment comments commentlist replies reply respond disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall pagination pager tags toc search form toolbar copyright legal disclaimer skip contentinfo complementary dialog sr hidden".split())
MAIN_WORDS = frozenset("main content article post entry story body text".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(class|id|role|aria-label|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z]+", re.I)
SPACE = re.compile(r"[\s ]+")
PUNCTUATION = re.compile(r"[,;:.!?…。，、！？]")


def _foreign(tag: str, attributes: str) -> bool:
    if tag in FOREIGN:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role"):
            words = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)))
            if words & OTHER_WORDS and not (tag in ("article", "main", "body", "html")) and not (words & MAIN_WORDS and not words & {"ad", "ads", "comment", "comments", "sidebar", "footer", "nav", "menu", "header", "related"}):
                return True
    return False


def blocks(page: str) -> list[tuple[str, str, bool, str]]:
    """The page's blocks in order: (text, tag path, stands in foreign matter, path of the article or main element around it)."""
    out: list[tuple[str, str, bool, str]] = []
    stack: list[tuple[str, bool, str]] = []  # tag, foreign, path of the main element
    parts: list[str] = []
    state = ("", False, "")

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((text, *state))
            parts.clear()

    def close_to(depth: int) -> None:
        nonlocal inside
        del stack[depth:]
        inside = (stack[-1][1], stack[-1][2]) if stack else (False, "")

    inside, pos = (False, ""), 0
    while True:
        found = MARKUP.search(page, pos)
        raw = page[pos:found.start()] if found else page[pos:]
        if raw:
            if not parts:
                state = (".".join(t for t, *_ in stack if t in BLOCK), *inside)
            parts.append(raw)
        if not found:
            break
        pos = found.end()
        closing, tag, attributes = found[1], (found[2] or "").lower(), found[3] or ""
        if not tag:
            continue
        if closing:
            if tag in BLOCK:
                flush()
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None and (tag in BLOCK or not any(t in BLOCK for t, *_ in stack[depth:])):
                if stack[depth][1] != inside[0]:
                    flush()
                close_to(depth)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            if not attributes.rstrip().endswith("/"):
                pos = end.end() if end else len(page) if tag in ("script", "style") else pos
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and parts:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), None)
                if depth is not None and not any(t in BLOCK for t, *_ in stack[depth + 1:]):
                    close_to(depth)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                lists = ("ul", "ol", "dl", "table", "menu")
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in same or stack[k][0] in lists), None)
                if depth is not None and stack[depth][0] in same:
                    close_to(depth)
            if tag == "body" and stack and stack[-1][0] == "head":
                close_to(len(stack) - 1)
        foreign = inside[0] or _foreign(tag, attributes) and not (tag == "header" and inside[1])
        if foreign and not inside[0]:
            flush()
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        main = inside[1] or (".".join([t for t, *_ in stack if t in BLOCK] + [tag]) if tag in ("article", "main") else "")
        inside = (foreign, main)
        stack.append((tag, *inside))
    flush()
    return out


def main_text(page: str | None, sigma: float = 1.0, threshold: float = 0.35, outside: float = 0.25) -> str:
    """Blocks of the main text, joined by line breaks; empty for a null or empty page and where nothing is left.

    Blocks inside an article or main element share the ratios of that element's own path, so its short paragraphs stand
    or fall with it; where a page has such an element, text beside it is discounted by ``outside``.
    """
    found = [b for b in blocks(page or "") if not b[2]]
    if not found:
        return ""
    keys = [b[3] or b[1] for b in found]
    length, marks, nodes = {}, {}, {}
    for key, (text, *_) in zip(keys, found):
        nodes[key] = nodes.get(key, 0) + 1
        length[key] = length.get(key, 0) + len(text)
        marks[key] = marks.get(key, 0) + len(PUNCTUATION.findall(text))
    marked = any(b[3] for b in found)
    weight = np.array([outside if marked and not b[3] else 1.0 for b in found])
    ratio = weight * [length[k] / nodes[k] for k in keys]
    points = weight * [marks[k] / nodes[k] for k in keys]
    near = np.exp(-0.5 * (np.arange(-2, 3) / sigma) ** 2)
    near /= near.sum()
    smooth = lambda v: np.log1p(np.convolve(np.pad(v, 2, mode="edge"), near, "valid"))
    fused, own = smooth(ratio) + smooth(points), np.log1p(ratio) + np.log1p(points)
    limit = threshold * max(fused.max(), own.max()) + 0.1 * own.std()
    keep = np.maximum(np.where(own > 0.5 * limit, fused, 0), own) >= limit
    for k, b in enumerate(found):  # a heading goes with what follows it
        if not keep[k] and b[1].rpartition(".")[2] in HEADINGS and k + 1 < len(found) and keep[k + 1]:
            keep[k] = True
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without its ``html`` column but with ``out``, the main text of each whole page.

    A null, empty or text-free page has the empty text. References are decoded, white space inside a block is one space,
    blocks keep the page's order; repeated rows are treated alike, other columns pass through, an existing ``out`` is replaced. One pass, no
    shuffle: a page needs nothing but itself.
    """
    kept = [c for c in pages.columns if c not in (html, out)]
    schema = pages.select(*kept).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, len(kept)):
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array([main_text(t) for t in texts], pa.string())], schema.names)

    return pages.select(*kept, F.col(html).cast("string").alias("__html")).transform(arrow_map, run, schema)


@query("op5_html_extraction")
def op5(t):
    return extract(t("pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
