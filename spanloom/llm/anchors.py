"""Anchors of fixed-length byte strings.

Every string of `length` bytes holds length - q + 1 q-grams; the one of smallest hash
(leftmost of equal ones) is its anchor, whatever stands around the string. Consecutive
strings with one anchor are a run, so a text of n bytes has about 2n / (length - q + 2) runs.
"""

from __future__ import annotations

import numpy as np

from spanloom.llm import textbuf

_POS = np.uint64((1 << 28) - 1)
_LEFT, _ORDER = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: A longer text is cut into pieces that overlap by length - 1 bytes, so that every string stands in one.
PIECE = 1 << 22


def refined_ids(grams: np.ndarray, at: np.ndarray, q: int, depth: int) -> np.ndarray:
    """Identifiers of the `depth` bytes at each of `at`, from those of the q-gram buckets at every offset.

    A refinement joins the identifier of a bucket with that of a later offset's, at no more than twice
    the depth, and the next one reads what it made: q, 2q, 4q, ..., depth.
    """
    if depth == q:
        return textbuf.mix(grams[at])
    known = q
    while 2 * known < depth:
        known *= 2
    here, later = refined_ids(grams, at, q, known), refined_ids(grams, at + (depth - known), q, known)
    return textbuf.mix(here * _LEFT + later)


def runs(data: np.ndarray, off: np.ndarray, length: int, q: int):
    """(text, first start, last start, bucket, context) of every run of the texts in a buffer.

    bucket: identifier of the anchor's q-gram. context: identifier of the run's bytes, from its first
    string's start to its last string's end: those of both strings, and how far they are apart.
    """
    n, w = len(data), length - q + 1
    none = np.zeros(0, np.int64)
    sums = textbuf.prefix_sums(data)
    size = np.diff(off)
    starts = off[:-1][size >= length]
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), sums
    gram = (sums[q:] - sums[:-q]) * textbuf.powers(n - q + 1, True)
    low = gram * _ORDER  # any order of the q-grams will do that is the same everywhere
    low &= ~_POS
    low |= np.arange(n - q + 1, dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: -(w - width)], low[w - width :])
    # a run ends where the anchor changes, and where a text has no further string
    new = np.ones(len(low) + 1, bool)
    np.not_equal(low[1:], low[:-1], out=new[1:-1])
    past = starts + size[size >= length] - length + 1
    new[starts] = new[past] = True
    head = np.flatnonzero(new)
    text = np.searchsorted(off, head[:-1], "right") - 1
    own = head[:-1] <= off[text + 1] - length
    text, first, last = text[own], head[:-1][own], head[1:][own] - 1
    anchor = (low[first] & _POS).astype(np.int64)
    context = textbuf.mix((refined_ids(gram, first, q, length) * _LEFT + refined_ids(gram, last, q, length)) * _LEFT + (last - first).astype(np.uint64))
    return text, first, last, refined_ids(gram, anchor, q, q), context, sums


def pieces(data: np.ndarray, off: np.ndarray, length: int):
    """Slabs of whole texts, and overlapping pieces of texts longer than PIECE: (first text, bytes, offsets, shift)."""
    for i, j, part, at in textbuf.slabs(data, off):
        if j - i > 1 or len(part) <= PIECE:
            yield i, part, at, 0
            continue
        for k in range(0, len(part) - length + 1, PIECE):
            piece = part[k : k + PIECE + length - 1]
            yield i, piece, np.array([0, len(piece)]), k
