"""Splitting of oversized items at natural boundaries, by lexical cohesion.

Only rows above the limit leave the JVM; each text is cut on its own, so the operator has no shuffle
besides the removal of repeated rows, and a text's length is the only bound on a task's memory.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.tokens import WIDE_CLASS, estimate_tokens
from quire.session import ship

LEVELS = ("paragraph", "sentence", "word", "none")
#: Words on either side of a gap that are compared.
BLOCK = 40

_WIDE = re.compile(WIDE_CLASS)
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[。！？]\s*|[.!?]\s+(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_TERM = re.compile(WIDE_CLASS + r"|[^\W\d_]+")


class Estimate:
    """Token estimates of any substring of a text, from prefix counts of its wide characters."""

    def __init__(self, text: str):
        self.text = text
        self.wide = [m.start() for m in _WIDE.finditer(text)]

    def __call__(self, start: int, end: int) -> int:
        if end <= start:
            return 0
        c = bisect.bisect_left(self.wide, end) - bisect.bisect_left(self.wide, start)
        return max(1, math.floor(c * 0.6 + (end - start - c) * 0.3 + 0.999))

    def stripped(self, start: int, end: int) -> int:
        part = self.text[start:end]
        left = len(part) - len(part.lstrip())
        return self(start + left, start + len(part.rstrip()))


def cuts(text: str, level: str) -> list[int]:
    """Positions at which the text may be cut on this level; a coarser level's cuts are part of a finer one's."""
    if level == "none":
        return list(range(1, len(text)))
    found = {m.end() for m in _PARAGRAPH.finditer(text)}
    if level != "paragraph":
        found |= {m.end() for m in (_SENTENCE if level == "sentence" else _SPACE).finditer(text)}
    return sorted(x for x in found if 0 < x < len(text))


def cut_level(text: str, limit: int, estimate: Estimate | None = None) -> str:
    """The coarsest level whose stretches, without white space at their ends, all fit the limit."""
    e = estimate or Estimate(text)
    for level in LEVELS[:-1]:
        edges = [0, *cuts(text, level), len(text)]
        if all(e.stripped(a, b) <= limit for a, b in zip(edges, edges[1:])):
            return level
    return "none"


def _valleys(text: str, gaps: list[int]) -> list[float]:
    """The depth of the valley in lexical cohesion at each gap: how far the similarity of the words on
    both sides lies below the nearest peaks to the left and right."""
    spans = [(m.start(), m.group().lower()) for m in _TERM.finditer(text)]
    starts, words = [s for s, _ in spans], [w for _, w in spans]
    sims = []
    left, right, lo, mid, hi = Counter(), Counter(), 0, 0, 0
    for g in gaps:
        at = bisect.bisect_left(starts, g)
        new_lo, new_hi = max(0, at - BLOCK), min(len(words), at + BLOCK)
        if new_lo >= mid or new_hi < hi:
            left, right = Counter(words[new_lo:at]), Counter(words[at:new_hi])
        else:  # slide both windows
            for w in words[hi:new_hi]:
                right[w] += 1
            for w in words[mid:at]:
                left[w] += 1
                right[w] -= 1
            for w in words[lo:new_lo]:
                left[w] -= 1
        lo, mid, hi = new_lo, at, new_hi
        dot = sum(n * right[w] for w, n in left.items() if w in right)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        sims.append(dot / norm if norm else 0.0)
    depth = [0.0] * len(sims)
    for order in (range(len(sims)), range(len(sims) - 1, -1, -1)):
        peak, last = 0.0, 0.0
        for i in order:  # climb from the gap for as long as the similarity rises
            peak = peak if sims[i] < last else sims[i]
            depth[i] += peak - sims[i]
            last = sims[i]
    return depth


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(overlap start, new start, end, level of the cut at the end) of the pieces; together the parts
    from new start to end are the text.  The piece is text[overlap start:end]."""
    e = Estimate(text)
    by_level = {}

    def at(level: str) -> tuple[list[int], list[float]]:
        if level not in by_level:
            gaps = cuts(text, level)
            by_level[level] = (gaps, _valleys(text, gaps) if level in ("paragraph", "sentence") else [])
        return by_level[level]

    out, start, back = [], 0, 0
    while e(back, len(text)) > limit:
        # the furthest end of a piece that begins at back
        lo, hi = start + 1, len(text)
        while lo < hi:
            m = (lo + hi + 1) // 2
            lo, hi = (m, hi) if e(back, m) <= limit else (lo, m - 1)
        far = lo
        end, level = far, "none"
        for level in LEVELS[:-1]:
            gaps, depth = at(level)
            i, j = bisect.bisect_right(gaps, start), bisect.bisect_right(gaps, far)
            if i == j:
                continue
            # of the window the deepest valley that leaves a piece more new text than overlap, of equals the last; else the last cut
            least = bisect.bisect_left(gaps, True, i, j, key=lambda g: e(start, g) > overlap)
            if depth and least < j:
                end = gaps[max(range(least, j), key=lambda k: (depth[k], k))]
            else:
                end = gaps[j - 1]
            break
        else:
            level = "none"
        out.append((back, start, end, level))
        start = end
        # the next piece begins with at most the last `overlap` tokens of this one, at a word if it can
        lo, hi = back, end
        while lo < hi:
            m = (lo + hi) // 2
            lo, hi = (lo, m) if e(m, end) <= overlap else (m + 1, hi)
        back = lo
        if 0 < back < end and not text[back - 1].isspace() and not _WIDE.match(text[back]):
            nxt = _SPACE.search(text, back, end)
            if nxt and nxt.end() < end and e(nxt.end(), end) >= overlap * 0.75:
                back = nxt.end()
    out.append((back, start, len(text), "end"))
    return out


def oversized(df: DataFrame, limit: int, whole_types: list[str]) -> DataFrame:
    """(id, text) of the rows above the limit, each id once; no text of at most limit / 0.6 characters
    can be above it, so most rows are decided by their length."""
    text = F.col("source_text")
    rows = df.filter(
        F.col("id").isNotNull() & (F.length(text) * 0.6 + 0.999 > limit) & ~F.coalesce(F.col("node_type"), F.lit("")).isin(whole_types)
    ).filter(estimate_tokens(text) > limit)
    return rows.groupBy("id").agg(F.min("source_text").alias("text"))


#: Node types that are never cut.
WHOLE_TYPES = ["formula", "code", "image", "html_table", "markdown_table", "page_marker"]


def split_nodes(df: DataFrame, limit: int = 600, overlap: int = 60) -> DataFrame:
    """(node_id, cut_level, piece_no, text_start, new_start, text_end, tokens, boundary, text), one row per piece.

    Rows with a null id or text, at or below the limit, or of a type that stays whole give no rows; a
    repeated id counts once, with the least of its texts.  text_start is where the overlap begins,
    new_start where the piece's own text does (0-based), boundary the level of the cut that ends the piece ('end' for
    the last).  An empty table gives no rows; other columns of ``df`` are ignored.
    """

    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"]):
                e = Estimate(text)
                level = cut_level(text, limit, e)
                for k, (back, start, end, kind) in enumerate(split_text(text, limit, overlap), 1):
                    rows.append((i, level, k, back, start, end, e(back, end), kind, text[back:end]))
            yield pd.DataFrame(rows, columns=["node_id", "cut_level", "piece_no", "text_start", "new_start", "text_end", "tokens", "boundary", "text"])

    return oversized(df, limit, WHOLE_TYPES).mapInPandas(
        run, "node_id BIGINT, cut_level STRING, piece_no INT, text_start INT, new_start INT, text_end INT, tokens INT, boundary STRING, text STRING"
    )


def found(df: DataFrame, limit: int = 600, overlap: int = 60) -> DataFrame:
    """(node_id, cut_level): one row per node that must be split, from its pieces."""
    return split_nodes(df, limit, overlap).filter("piece_no = 1").select("node_id", "cut_level")
