"""Main text of HTML pages by the distribution of line blocks.

Scripts, styles, comments and other invisible parts go with all they hold; tags of block elements become line ends, other tags vanish,
entities are decoded and white space is squeezed. Line ends of the source are white space, but for those inside ``pre``. A line's *block* is the text length of the ``width`` lines that begin there. Reading starts
at a surge, a block of at least ``surge`` characters in more than one line or a line of at least ``long`` on its own, and stops at a dive, the first line after it with which an
empty stretch of ``width`` lines begins, or the end of the page. The text between is kept, from each surge to its dive. On a page without
such a block, the longest block is the surge.

A null page gives null; a page without text gives an empty text. Unclosed invisible parts reach to the end of the page, but a head ends where the body begins; a tag without its
closing bracket is text. The work is in proportion to the page. Rows are handled one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import bounded, pieces

WIDTH, SURGE, LONG = 3, 86, 258

_INVISIBLE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)|<![^>]*>|<\?[^>]*>", re.S | re.I)
#: Elements that break lines; those of a page's frame leave a gap as wide as a block, as they stand apart from the text around them.
_BLOCK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|h[1-6]|blockquote|pre|figure|figcaption|section|body|html|form|address|center|fieldset)\b[^>]*>", re.I)
_FRAME = re.compile(r"</?(?:nav|header|footer|aside|menu|main|article)\b[^>]*>", re.I)
#: The end of a paragraph and the beginning of the next one are one line end.
_BREAKS = re.compile(r"[ \t]*\x01[ \t\x01]*")
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_PRE = re.compile(r"(<pre\b[^>]*>.*?(?:</pre\s*>|\Z))", re.S | re.I)
_SOURCE_SPACE = re.compile(r"[ \t\n\f\r]+")
_SPACE = re.compile(r"[^\S\n]+")


def lines_of(page: str, width: int = WIDTH) -> list[str]:
    """Lines of text of a page, empty ones among them."""
    page = page.replace("\x01", " ").replace("\x02", " ")
    # behind the last bracket no tag ends, and an expression that looks for an end would look again from each beginning
    last = page.rfind(">") + 1
    rest, comment, _ = page[last:].partition("<!--")
    page = page[:last] + rest.replace("<", "\x02") + (f"{comment}-->" if comment else "")
    text = _INVISIBLE.sub(" ", page)
    text = "".join(part if k % 2 else _SOURCE_SPACE.sub(" ", part) for k, part in enumerate(_PRE.split(text)))
    text = _FRAME.sub("\n" * (width + 1), text)
    text = _BREAKS.sub("\n", _TAG.sub("", _BLOCK.sub("\x01", text)))
    text = html.unescape(text.replace("\x02", "<")).replace("\r\n", "\n").replace("\r", "\n")
    return [line.strip() for line in _SPACE.sub(" ", text).split("\n")]


def kept_lines(lengths: list[int], width: int = WIDTH, surge: int = SURGE, long: int | None = None) -> list[tuple[int, int]]:
    """Ranges of lines that are kept, from surges to dives. Without ``long``, no line is a surge on its own."""
    n = len(lengths)
    sums = [0]
    for v in lengths:
        sums.append(sums[-1] + v)
    block = [sums[min(n, k + width)] - sums[k] for k in range(n)]
    most = max(block, default=0)
    if not most:
        return []
    # a single line between empty ones, such as a notice in a footer, is no surge, unless it is as long as a paragraph or the page has nothing else
    good = [lengths[k] > 0 and (block[k] > lengths[k] or long is not None and lengths[k] >= long) for k in range(n)]
    surges = [block[k] for k in range(n) if good[k]]
    alone = not surges
    surge = min(surge, max(surges, default=most))
    out, k = [], 0
    while k < n:
        if lengths[k] and block[k] >= surge and (good[k] or alone):
            end = k
            while end < n and block[end]:
                end += 1
            out.append((k, end))
            k = end
        k += 1
    return out


def main_text(page: str, width: int = WIDTH, surge: int = SURGE, long: int = LONG) -> str:
    lines = lines_of(page, width)
    return "\n".join(line for a, b in kept_lines([len(x) for x in lines], width, surge, long) for line in lines[a:b] if line)


def _extract(width: int, surge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 512):
                texts = [None if p is None else main_text(p, width, surge) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extracted(pages: DataFrame, width: int = WIDTH, surge: int = SURGE) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages``."""
    if width < 1 or surge < 1:
        raise ValueError("width and surge must be at least 1")
    bounded(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(_extract(width, surge), "page_id long, url string, text string, n_chars long")
