"""Recursive character splitting with overlap and exact offsets.

A text is cut before every paragraph break; what is still too long there is cut before
line breaks, then sentences, words and characters. Neighbouring pieces are packed into chunks of at most
`size` characters that repeat up to `overlap` of the one before. Everything is done on positions, so a
chunk's offsets are those it was cut at, also where its text occurs more than once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _bounds(text: str, a: int, z: int, sep: str) -> list[int]:
    """a, the starts of separators, z; neighbours enclose a piece."""
    if not sep:
        return list(range(a, z + 1))
    out, at = [a], text.find(sep, a, z)
    while at >= 0:
        if at > a:
            out.append(at)
        at = text.find(sep, at + len(sep), z)
    return [*out, z]


def _packed(bounds: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks of whole pieces, greedily filled."""
    first = 0
    for k in range(1, len(bounds)):
        if k - 1 > first and bounds[k] - bounds[first] > size:
            yield bounds[first], bounds[k - 1]
            while first < k - 1 and (bounds[k - 1] - bounds[first] > overlap or bounds[k] - bounds[first] > size):
                first += 1
    yield bounds[first], bounds[-1]


def _spans(text: str, a: int, z: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while SEPARATORS[level] and text.find(SEPARATORS[level], a, z) < 0:
        level += 1
    run = [a]
    for lo, hi in pairwise(_bounds(text, a, z, SEPARATORS[level])):
        if hi - lo < size or level + 1 == len(SEPARATORS):
            run.append(hi)
            continue
        if len(run) > 1:
            yield from _packed(run, size, overlap)
        yield from _spans(text, lo, hi, level + 1, size, overlap)
        run = [hi]
    if len(run) > 1:
        yield from _packed(run, size, overlap)


def chunks(text: str, size: int = 1500, overlap: int = 150) -> list[tuple[int, int, int, str]]:
    """(index, start, end, chunk), outer white space left out; a short text is one chunk, so is one that has nothing else."""
    if overlap >= size:
        raise ValueError("overlap must be below the size")
    out: list[tuple[int, int, int, str]] = []
    for a, z in _spans(text, 0, len(text), 0, size, overlap) if len(text) > size else ():
        piece = text[a:z]
        a += len(piece) - len(piece.lstrip())
        if piece := piece.strip():
            out.append((len(out), a, a + len(piece), piece))
    return out or [(0, 0, len(text), text)]
