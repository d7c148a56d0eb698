"""Markdown outlines: headings, sections, node ids."""

from __future__ import annotations

import re

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]|$)")
CLOSING = re.compile(r"(?:^|[ \t]+)#+$")
SETEXT = re.compile(r" {0,3}(?:(=+)|(-+))[ \t]*$")
RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
CODE = re.compile(r"(?: {4}|\t)")
STARTS_BLOCK = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]|$)| {0,3}>")
FENCES, UNDERLINES = "`~", "=-"
ROOT = "root"
SLUG_CHARS = 64


def split_lines(text: str) -> tuple[list[str], list[int]]:
    """Lines by \\r\\n or \\n and their starts; always at least one."""
    out, starts, at = [], [], 0
    for m in re.finditer(r"\r?\n", text):
        out.append(text[at : m.start()])
        starts.append(at)
        at = m.end()
    return [*out, text[at:]], [*starts, at]


def slug(title: str) -> str:
    s = re.sub(r"[^\w]+", "-", title.strip().lower()).strip("-")
    return s[:SLUG_CHARS].rstrip("-") or "section"


def _fence(line: str) -> tuple[str, int, bool, bool] | None:
    """(sign, length, may open, may close) of a code fence line."""
    m = FENCE.match(line)
    return m and (m[1][0], len(m[1]), m[1][0] == "~" or "`" not in m[2], not m[2].strip())


def headings(text: str) -> list[tuple[int, str, int]]:
    """(level, title, start) of ATX and setext headings, by the block rules of Markdown; code fences count if they close.

    One pass forward over the lines keeps the open fence and the open paragraph; whether a fence
    closes is known from the longest closing fence of its sign below, found from the end first.
    """
    lines, starts = split_lines(text)
    signs = [x.lstrip(" ")[:1] for x in lines]  # tells most patterns apart without trying them
    fences = [_fence(x) if c in FENCES and c else None for x, c in zip(lines, signs, strict=True)]
    below, longest = [], {"`": 0, "~": 0}
    for f in reversed(fences):
        below.append((longest["`"], longest["~"]))
        if f and f[3]:
            longest[f[0]] = max(longest[f[0]], f[1])
    below.reverse()

    out: list[tuple[int, str, int]] = []
    paragraph: list[tuple[str, int]] = []
    closer: tuple[str, int] | None = None
    for line, sign, start, fence, after in zip(lines, signs, starts, fences, below, strict=True):
        if closer:
            if fence and fence[3] and fence[0] == closer[0] and fence[1] >= closer[1]:
                closer = None
        elif fence and fence[2]:
            paragraph.clear()
            if after["`~".index(fence[0])] >= fence[1]:
                closer = fence[:2]
        elif sign == "#" and (m := ATX.match(line)):
            paragraph.clear()
            title = line[m.end() :].strip()
            out.append((len(m[1]), CLOSING.sub("", title).strip() if title.endswith("#") else title, start))
        elif paragraph and sign and sign in UNDERLINES and (m := SETEXT.match(line)):
            out.append((1 if m[1] else 2, " ".join(x.strip() for x, _ in paragraph), paragraph[0][1]))
            paragraph.clear()
        elif not line.strip() or CODE.match(line) or (not sign.isalpha() and (STARTS_BLOCK.match(line) or RULE.match(line))):
            paragraph.clear()
        else:
            if paragraph and SETEXT.match(paragraph[-1][0]):  # an underline below nothing is text, but joins no paragraph
                paragraph.clear()
            paragraph.append((line, start))
    return out


def outline(text: str, max_depth: int = 6) -> list[dict]:
    """Nodes in order: node_id, level, ordinal, title, char_start, char_end, parent_id. Ids don't depend on max_depth.

    An id is the path of slugs; a slug that siblings have taken gets the next free number, which is its ordinal.
    """
    nodes: list[dict] = []
    above: list[dict] = []
    taken, last = {ROOT}, {}
    for level, title, start in headings(text):
        above = [x for x in above if x["level"] < level]
        base = f"{above[-1]['node_id']}/{slug(title)}" if above else slug(title)
        n = last.get(base, 0) + 1
        while (node_id := base if n == 1 else f"{base}-{n}") in taken:
            n += 1
        taken.add(node_id)
        last[base] = n
        above.append({"node_id": node_id, "level": level, "ordinal": n, "title": title, "char_start": start})
        nodes.append(above[-1])
    shown = [x for x in nodes if x["level"] <= max_depth]
    following: list[dict] = []  # later nodes that may end a section, nearest last
    for x in reversed(shown):
        while following and following[-1]["level"] > x["level"]:
            following.pop()
        x["char_end"] = following[-1]["char_start"] if following else len(text)
        following.append(x)
    above = []
    for x in shown:
        above = [y for y in above if y["level"] < x["level"]]
        x["parent_id"] = above[-1]["node_id"] if above else ROOT
        above.append(x)
    return [{"node_id": ROOT, "level": 0, "ordinal": 1, "title": "", "char_start": 0, "char_end": len(text), "parent_id": None}, *shown]


def span_of(text: str, node_id: str) -> tuple[int, int] | None:
    return next(((x["char_start"], x["char_end"]) for x in outline(text) if x["node_id"] == node_id), None)
