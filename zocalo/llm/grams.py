"""Histograms of hashed character and word n-grams for batches of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Characters that are worked on at once; longer texts are taken in slices that share the characters a gram may span.
SLICE = 1 << 19

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters_only(points: np.ndarray) -> np.ndarray:
    """Code points with every ASCII character that is no letter as a blank."""
    plain = points < 128
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    return np.where(plain & ~letter, np.uint32(32), points)


def gram_buckets(points: np.ndarray, order: int, bits: int, salt: int = 0) -> np.ndarray:
    """Bucket of the gram that starts at each position, for positions with ``order`` characters left."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, (order * 0x9E3779B9 + salt) & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ points[k:k + n]) * _FACTORS[k]
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def word_buckets(points: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each run between characters up to the blank."""
    inside = np.concatenate([[False], points > 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.int64)
    place = np.arange(len(points), dtype=np.uint64)
    lengths = ends - starts
    first = np.repeat(starts, lengths)
    at = np.flatnonzero(inside[1:-1])
    with np.errstate(over="ignore"):
        mixed = (points[at].astype(np.uint64) + np.uint64(1)) * ((place[at] - first.astype(np.uint64)) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(29)
        sums = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        sums ^= sums >> np.uint64(32)
        sums *= np.uint64(0x94D049BB133111EB)
    return (sums >> np.uint64(64 - bits)).astype(np.int64)


def histograms(texts: Iterable[str], orders: tuple[int, ...], bits: int, words: bool = False, letters: bool = False,
               rows: int = 256) -> Iterator[np.ndarray]:
    """Counts of the hashed grams of each text, ``rows`` texts a matrix (the last has fewer); float32 rows of 2**bits."""
    size, table = 1 << bits, []
    for text in texts:
        line = np.zeros(size, np.float32)
        points = letters_only(codes(text.lower())) if letters else codes(text)
        for a in range(0, len(points), SLICE):
            for order in orders:
                line += np.bincount(gram_buckets(points[a:a + SLICE + order - 1], order, bits), minlength=size)
        if words:
            line += np.bincount(word_buckets(points, bits), minlength=size)
        table.append(line)
        if len(table) == rows:
            yield np.stack(table)
            table = []
    if table:
        yield np.stack(table)


def bucket_lists(texts: Iterable[str], orders: tuple[int, ...], bits: int, letters: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the text, buckets of the hashed grams in a slice of it, repeats included); nothing for a text without a gram."""
    for i, text in enumerate(texts):
        points = letters_only(codes(text.lower())) if letters else codes(text)
        for a in range(0, len(points), SLICE):
            found = [gram_buckets(points[a:a + SLICE + order - 1], order, bits) for order in orders]
            yield i, np.concatenate(found)


def sums_by_text(lists: Iterable[tuple[int, np.ndarray]], count: int, matrix: np.ndarray, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` texts the sum of the matrix rows of its buckets, and how many buckets that are.

    Only rows that a text asks for are read: they are gathered for many texts at once and added up between the texts' edges.
    """
    sums, sizes = np.zeros((count, matrix.shape[1])), np.zeros(count, np.int64)
    owners: list[int] = []
    held: list[np.ndarray] = []

    def add() -> None:
        used = [(i, b) for i, b in zip(owners, held) if len(b)]
        if used:
            edges = np.cumsum([0] + [len(b) for _, b in used[:-1]])
            np.add.at(sums, [i for i, _ in used], np.add.reduceat(matrix[np.concatenate([b for _, b in used])], edges, axis=0, dtype=float))
        owners.clear()
        held.clear()

    pending = 0
    for i, found in lists:
        sizes[i] += len(found)
        for a in range(0, len(found), at_once):
            owners.append(i)
            held.append(found[a:a + at_once])
            pending += len(held[-1])
            if pending >= at_once:
                add()
                pending = 0
    add()
    return sums, sizes
