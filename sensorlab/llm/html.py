"""Main text of web pages: text-to-tag ratios of lines from streaming parser events.

The standard library's parser streams tags and text. A line is a block of the
page: what lies between two block-level tags. Lines in menus, headers, footers,
sidebars, forms and the like, told by tag, role, or a word of class or id, have
no text of their own. Each other line has a ratio of its characters to its
tags. The ratios are smoothed by a Gaussian, so that short paragraphs among long
ones hold and lone ones don't, and clustered by a threshold, a part of their
deviation. A page that marks its article says where to look: only its lines are
candidates, and their ratios are at least the threshold.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import map_arrow

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "head title nav footer aside form script style noscript template svg math button select textarea iframe object canvas audio video menu dialog datalist".split()
)
MARKED = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar header masthead "
    "topbar footer sidebar sidenav aside breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices banner alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending widget "
    "comment comments disqus respond reply replies discussion skip toolbar".split()
)
OPENED = BLOCKS | LEFT_OUT | frozenset(["td", "th", "span", "a", "ins", "label"])
SPACED = frozenset(["br", "td", "th", "img", "hr", "wbr"]) - {"wbr"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_TOKEN = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / 1.5) ** 2)
THRESHOLD = 0.5


class _Lines(HTMLParser):
    """Collects lines: text, number of tags, whether left out, whether in a marked article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, leaves out, marks
        self.text: list[str] = []
        self.tags = self.left_out = self.marked = 0

    def _line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            self.lines.append((text, self.tags, self.left_out > 0, self.marked > 0))
        self.text, self.tags = [], 0

    def _close(self, at: int) -> None:
        for _, out, marks in self.open[at:]:
            self.left_out -= out
            self.marked -= marks
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._line()
            if self.open and self.open[-1][0] == "p" or tag == "li" and self.open and self.open[-1][0] == "li":
                self._close(len(self.open) - 1)
            if tag == "body":
                self._close(next((i for i, o in enumerate(self.open) if o[0] == "head"), len(self.open)))
        elif tag in SPACED:
            self.text.append(" ")
        self.tags += 1
        if tag in VOID or tag not in OPENED:
            return
        out = tag in LEFT_OUT or tag == "header" and not self.marked
        for name, value in attrs:
            if out:
                break
            value = value or ""
            if name in ("class", "id") and tag not in ("html", "body") and tag not in MARKED:
                out = any(t.lower() in WORDS for t in _TOKEN.split(value))
            elif name == "role":
                out = value.strip().lower() in ROLES
            elif name == "hidden":
                out = True
            elif name == "aria-hidden":
                out = value.strip().lower() == "true"
            elif name == "style":
                out = bool(_HIDDEN.search(value))
        marks = tag in MARKED
        self.open.append((tag, out, marks))
        self.left_out += out
        self.marked += marks

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if tag not in OPENED:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        if self.left_out:
            return
        self.text.append(data)


def content_lines(lines: list[tuple[str, int, bool, bool]]) -> list[str]:
    """The lines of the content regions."""
    usable = np.array([bool(text) and not out for text, _, out, _ in lines], bool)
    if not usable.any():
        return []
    size = np.array([len(text) if ok else 0 for (text, *_), ok in zip(lines, usable, strict=True)], float)
    tags = np.array([max(t, 1) for _, t, _, _ in lines], float)
    smooth = np.convolve(size / tags, KERNEL / KERNEL.sum(), mode="full")[3:-3]
    # The deviation of the smoothed ratios parts content from the rest.
    level = THRESHOLD * smooth.std()
    marked = np.array([m for *_, m in lines], bool) & usable
    if marked.any():
        smooth = np.where(marked, np.maximum(smooth, level), -1.0)
    return [text for (text, *_), s, ok in zip(lines, smooth, usable, strict=True) if ok and s >= level]


def main_text(html: str | None) -> str:
    """The page's main text, a block a line; empty for a null or empty page."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._line()
    return "\n".join(content_lines(parser.lines))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars`` (code points). Repeated rows and null ids are pages as any."""
    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h).encode("utf-8", "replace").decode() for h in batch.column("_html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [id_col, url_col, "text", "n_chars"],
        )

    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).alias("_html"))
    return map_arrow(rows, extract, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
