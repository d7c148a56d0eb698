"""Passages around highlighted matches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

SEPARATORS = ("\n\n", "\n", ". ", " ")
MAX_PASSAGE = int(0.95 * 512 * 4)


def regions(marked: str, text: str) -> list[tuple[int, int]]:
    """Spans of <mark> pairs in the text's own positions; marks that the text itself holds aren't counted."""
    out, opened, at, pos = [], [], 0, 0
    for m in re.finditer(r"</?mark>", marked):
        between = m.start() - at
        if text[pos : pos + between] != marked[at : m.start()]:
            return []
        pos, at = pos + between, m.end()
        if text.startswith(m.group(), pos):
            pos += len(m.group())
        elif m.group() == "<mark>":
            opened.append(pos)
        elif opened:
            out.append((opened.pop(), pos))
        else:
            return []
    if opened or text[pos:] != marked[at:]:
        return []
    return sorted(out)


def breaks(text: str) -> list[list[int]]:
    """For each separator, strongest first, the sorted positions just behind it."""
    return [[m.start() + len(s) for m in re.finditer(f"(?={re.escape(s)})", text)] for s in SEPARATORS]


def snap(ends: list[list[int]], at: int, left: bool, reach: int = 200) -> int:
    """The nearest of the strongest breaks on one side within reach; `at` if there is none."""
    for s, cuts in zip(SEPARATORS, ends, strict=True):
        if left:
            i = bisect_right(cuts, at) - 1
            if i >= 0 and cuts[i] >= max(0, at - reach) + len(s):
                return cuts[i]
        else:
            i = bisect_left(cuts, at + len(s))
            if i < len(cuts) and cuts[i] <= at + reach:
                return cuts[i]
    return at


def coalesce(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Spans no more than gap apart become one."""
    spans = sorted(spans)
    reached = list(accumulate((b for _, b in spans), max))
    heads = [i for i in range(len(spans)) if not i or spans[i][0] > reached[i - 1] + gap]
    return [(spans[i][0], reached[j - 1]) for i, j in zip(heads, [*heads, len(spans)][1:], strict=True)]


def shorten(text: str, width: int) -> str:
    if len(text) <= width:
        return text
    cut = text.rfind(" ", 0, width)
    return text[: cut if cut > 0.7 * width else width] + "..."


def passage(text: str, marked: str | None, window: int = 750, limit: int = MAX_PASSAGE, gap: int = 100) -> str:
    """The text around its matches, snapped to separators, joined by ' ... '; its head if nothing is marked."""
    clean = lambda t: t.replace("<mark>", "").replace("</mark>", "")
    found = regions(marked, text) if marked else []
    if not found:
        return clean(text[:limit])
    ends = breaks(text)
    wide = [(snap(ends, max(0, a - window), True), snap(ends, min(len(text), b + window), False)) for a, b in found]
    return clean(shorten(" ... ".join(text[a:b] for a, b in coalesce(wide, gap)), limit))
