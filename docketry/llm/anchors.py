"""Content-defined anchors that split the search for repeated windows.

A window of ``window`` symbols that occurs twice holds the same symbols both
times, so the leftmost smallest gram hash inside it sits at the same offset
both times.  That gram is the window's *anchor*.  Every window of a document
is owned by exactly one anchor, and all windows owned by one anchor start in
one run, so a document falls into fragments: the symbols that the run covers.
Equal windows always lie in fragments with the same anchor gram.
"""

from __future__ import annotations

import numpy as np


def gram_hash(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of each run of ``gram`` symbols (a power of two), by doubling."""
    h = symbols.astype(np.uint32)
    h = h * np.uint32(2654435761) + np.uint32(974593)
    h ^= h >> np.uint32(15)
    width = 1
    while width < gram:
        h = h[:-width] * np.uint32(2246822519) + h[width:]
        h ^= h >> np.uint32(13)
        width *= 2
    h *= np.uint32(3266489917)
    h ^= h >> np.uint32(16)
    return h


def fragments(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows that lie inside one of the documents.

    ``symbols`` concatenates documents, document d being ``starts[d]:ends[d]``.
    Returns for each fragment the anchor's position, the first and the last
    window start that it owns, all as positions in ``symbols``.
    """
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    best = (gram_hash(symbols, gram).astype(np.uint64) << np.uint64(32)) | np.arange(n - gram + 1, dtype=np.uint64)
    span, width = window - gram + 1, 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that start within the last window - 1 symbols of a document cross its end.
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= window
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - window + 1, -1)
    ok = np.cumsum(inside)[: len(at)] > 0
    first = np.flatnonzero(ok & np.concatenate(([True], (at[1:] != at[:-1]) | ~ok[:-1])))
    last = np.flatnonzero(ok & np.concatenate(((at[1:] != at[:-1]) | ~ok[1:], [True])))
    return at[first], first, last
