"""Exact Jaccard join of a bounded group of sets, by a trie of globally ordered sets."""

from __future__ import annotations

import numpy as np


def required(a, b, percent: int):
    """The smallest overlap with which sets of sizes a and b reach the similarity."""
    return -(-(percent * (a + b)) // (100 + percent))


def trie_links(sets: list[np.ndarray], percent: int, split: int | None = None, block: int = 16, step: int = 96) -> list[tuple[int, int]]:
    """All pairs (i, j), i < j, with 100 x intersection >= percent x union.

    sets are sorted arrays without repeats, none empty. With `split`, only pairs of
    one set before it and one from it on.

    The sets, in one global order of their members, form a trie: sorted as sequences,
    a node is a run of neighbouring sets that share a prefix. The trie is traversed
    level by level for a block of queries at once; a node's overlap with a query is
    worked out once and handed down to all sets below it, and a subtree is left as
    soon as what is missing on either side exceeds what the remaining members allow.
    """
    total = len(sets)
    begin, ends = (0, total) if split is None else (split, split)
    if total < 2 or begin >= total or not ends:
        return []
    sizes = np.array([len(s) for s in sets])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    most = int(sizes[begin:].max())
    paths = np.full((total - begin, most), len(vocabulary), dtype=np.int64)
    for r in range(begin, total):
        paths[r - begin, : sizes[r]] = own[r]
    keys = [(own[r] + 1).astype(">u4").tobytes() for r in range(begin, total)]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
    paths, row_of = paths[order], order + begin
    b = sizes[row_of]
    fork = np.zeros(len(order), dtype=np.int64)  # where a set leaves the one before it
    if len(order) > 1:
        differ = paths[1:] != paths[:-1]
        fork[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    levels = np.unique(np.concatenate([fork, np.arange(0, most, step), [most]]))
    levels = levels[levels <= most]
    found = []
    block = max(1, min(block, 4_000_000 // (len(vocabulary) + 1)))  # the queries' members as a table
    for first in range(0, ends, block):
        queries = range(first, min(ends, first + block))
        a = sizes[first : queries[-1] + 1][:, None]
        member = np.zeros((len(queries), len(vocabulary) + 1), dtype=np.int8)
        for k, q in enumerate(queries):
            member[k, own[q]] = 1
        passed = np.cumsum(member, axis=1, dtype=np.int32)  # members of the query up to here in the order
        need = required(a, b[None, :], percent)
        alive = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        if split is None:
            alive &= row_of[None, :] > np.array(queries)[:, None]
        here = np.flatnonzero(alive.any(axis=0))  # the sets still of interest
        alive, need, at = alive[:, here], need[:, here], _forks(fork, here)
        overlap = np.zeros(alive.shape, dtype=np.int64)
        for d, e in zip(levels[:-1], levels[1:], strict=True):
            if not len(here):
                break
            starts = np.flatnonzero(at <= d)
            width = np.diff(np.append(starts, len(here)))
            gained = member[:, paths[here[starts], d:e]].sum(axis=2, dtype=np.int64)
            overlap += np.repeat(gained, width, axis=1)
            seen = np.minimum(b[here], e)
            last = paths[here, seen - 1]
            alive &= (seen - overlap <= b[here] - need) & (passed[:, last] - overlap <= a - need)
            if not (keep := alive.any(axis=0)).all():
                alive, need, overlap, here = alive[:, keep], need[:, keep], overlap[:, keep], here[keep]
                at = _forks(fork, here)
        for k, r in zip(*np.nonzero(alive & (overlap >= need)), strict=True):
            i, j = first + int(k), int(row_of[here[r]])
            found.append((min(i, j), max(i, j)))
    return found


def _forks(fork: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Where each of the kept sets leaves the kept one before it: the least fork between them."""
    if not len(here):
        return fork[:0]
    # up to the next kept set a segment each; what follows the last one is cut off
    out = np.minimum.reduceat(fork[: here[-1] + 1], np.concatenate([[0], here[:-1] + 1]))
    out[0] = 0
    return out


def brute_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The same by comparing all pairs; for tests."""
    out = []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                out.append((i, j))
    return out
