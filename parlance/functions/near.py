"""Search of token arrays for those whose ROUGE-L with another reaches a threshold.

Four bounds of the common subsequence, each dearer and closer than the one
before, stand ahead of the subsequence itself. With n and m tokens it must
have threshold * (n + m) / 2 of them.

* Lengths, and the common bits of two sketches. A token with the number of its
  repetition is a mark; marks are set bits by their hash. Marks that two arrays
  share set the same bits, and at most as many are hidden behind each other as
  the array with fewer collisions has of them. A small sketch of everything is
  read first, a large one of what is left.
* The marks of one array whose hash is among those of the other.
* A walk of the array past some parts of the other: the subsequence cuts it
  in as many stretches, and takes from a stretch at most the tokens that stand
  in its part.

Hashes that fall together only raise a bound, so nothing similar is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from parlance.functions.rouge import f_measure, lcs_length, position_masks
from parlance.functions.tokens import numbered

CODES = 1 << 16
COARSE, FINE = 1_024, 8_192
# Of the first walk, and of a second one past more parts.
PARTS = (8, 16)
# Tokens, and arrays, that are looked at together: a walk's numbers fit in 31 bits.
WALK_TOKENS, WALK_ARRAYS = 100_000, 4_096


def codes(ids: np.ndarray) -> np.ndarray:
    """16 bits of every id."""
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


class Entry:
    """A token array with its sketches."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.ascontiguousarray(ids, np.int64)
        self.codes = codes(self.ids)
        self.marks = codes(numbered(self.ids))
        held = np.zeros(FINE, bool)
        held[self.marks // (CODES // FINE)] = True
        coarse = held.reshape(COARSE, -1).any(axis=1)
        self.fine, self.coarse = np.packbits(held).view(np.uint64), np.packbits(coarse).view(np.uint64)
        self.hidden = len(ids) - held.sum(), len(ids) - coarse.sum()


class Shelf:
    """Token arrays to be searched, numbered as they are added."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.entries: list[Entry] = []
        self.coarse = np.zeros((COARSE // 64, 64), np.uint64)
        self.fine = np.zeros((64, FINE // 64), np.uint64)
        self.sizes, self.fine_hidden, self.coarse_hidden = (np.zeros(64, np.int64) for _ in range(3))
        self._held, self._parts = np.zeros(CODES, np.uint8), np.zeros(CODES, np.int32)

    def add(self, entry: Entry) -> None:
        at = len(self.entries)
        if at == len(self.sizes):
            self.coarse = np.hstack([self.coarse, np.zeros_like(self.coarse)])
            self.fine = np.vstack([self.fine, np.zeros_like(self.fine)])
            for name in ("sizes", "fine_hidden", "coarse_hidden"):
                setattr(self, name, np.append(getattr(self, name), np.zeros(at, np.int64)))
        self.entries.append(entry)
        self.coarse[:, at], self.fine[at], self.sizes[at] = entry.coarse, entry.fine, len(entry.ids)
        self.fine_hidden[at], self.coarse_hidden[at] = entry.hidden

    def _candidates(self, entry: Entry) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the arrays that may be similar by their marks, and what each must reach."""
        count, n = len(self.entries), len(entry.ids)
        sizes = self.sizes[:count]
        need = self.threshold * (sizes + n) / 2 - 1e-9
        common = np.zeros(count, np.uint16)
        for row, word in zip(self.coarse, entry.coarse):
            common += np.bitwise_count(row[:count] & word)
        bound = np.minimum(common + np.minimum(self.coarse_hidden[:count], entry.hidden[1]), np.minimum(sizes, n))
        at = np.flatnonzero(bound >= need)
        for lo in range(0, len(at), 1_024):
            part = at[lo : lo + 1_024]
            common = np.bitwise_count(self.fine[part] & entry.fine).sum(axis=1, dtype=np.int64)
            at[lo : lo + 1_024] = np.where(
                common + np.minimum(self.fine_hidden[part], entry.hidden[0]) >= need[part], part, -1
            )
        at = at[at >= 0]
        if not len(at):
            return at, need[at]
        self._held[entry.marks] = 1
        kept = []
        for part in self._runs(at):
            flat = np.concatenate([self.entries[i].marks for i in part])
            starts = np.append(0, np.cumsum(sizes[part])[:-1])
            kept.append(part[np.add.reduceat(self._held[flat], starts, dtype=np.int64) >= need[part]])
        self._held[entry.marks] = 0
        at = np.concatenate(kept)
        return at, need[at]

    def _runs(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """``at`` in runs of bounded tokens; one array may have more."""
        tokens = np.cumsum(self.sizes[at] + 1)
        start = 0
        while start < len(at):
            before = tokens[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(tokens, before + WALK_TOKENS, "right")))
            yield at[start : (start := min(end, start + WALK_ARRAYS))]

    def _walked(self, entry: Entry, at: np.ndarray, parts: int) -> np.ndarray:
        """Bound of the common subsequence with each array: its walk past the parts of ``entry``."""
        n = len(entry.ids)
        bits = np.int32(1) << (np.arange(n) * parts // n).astype(np.int32)
        np.bitwise_or.at(self._parts, entry.codes, bits)
        bounds = []
        for part in self._runs(at):
            # Tokens that stand in no part take no step.
            found = self._parts[np.concatenate([self.entries[i].codes for i in part])]
            some = found != 0
            starts = np.append(0, np.cumsum(self.sizes[part])[:-1])
            sizes = np.add.reduceat(some, starts, dtype=np.int64)
            ends = np.cumsum(sizes + 1)
            # Every array stands behind a place of its own, where its walk starts.
            taken = np.ones(ends[-1], bool)
            taken[ends - sizes - 1] = False
            inside = np.zeros(ends[-1], np.int32)
            inside[taken] = found[some]
            # A step per array that no walk makes up for: the running maximum starts anew.
            step = np.repeat(np.arange(len(part), dtype=np.int32) * np.int32(2 * ends[-1] + 1), sizes + 1)
            best, hit, seen = step.copy(), np.empty_like(inside), np.empty(ends[-1], np.int32)
            for k in range(parts):
                np.right_shift(inside, np.int32(k), out=hit)
                hit &= np.int32(1)
                np.cumsum(hit, dtype=np.int32, out=seen)
                best -= seen
                np.maximum.accumulate(best, out=best)
                best += seen
            bounds.append((best - step)[ends - 1])
        self._parts[entry.codes] = 0
        return np.concatenate(bounds)

    def similar(self, entry: Entry) -> Iterator[int]:
        """Numbers of the arrays whose F measure with ``entry`` reaches the threshold."""
        n = len(entry.ids)
        if not self.entries or not n:
            return
        at, need = self._candidates(entry)
        if not len(at):
            return
        for parts in PARTS:
            bound = self._walked(entry, at, parts)
            left = bound >= need
            at, need, bound = at[left], need[left], bound[left]
            if not len(at):
                return
        masks = position_masks(entry.ids.tolist())
        for k in np.argsort(need - bound, kind="stable"):
            other = self.entries[at[k]].ids
            lcs = lcs_length(masks, n, other.tolist(), need[k])
            if f_measure(lcs, n, len(other)) >= self.threshold:
                yield int(at[k])
