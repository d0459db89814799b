"""A run-length index over a small collection of byte strings, in numpy.

The suffix array is built by prefix doubling over still tied suffixes, and dropped. Of the Burrows-Wheeler
transform only the runs are kept, with the suffix array sampled at run heads and tails and the rows beside them.
Matching statistics are streamed from those samples: the longest match of position p with its neighbour in suffix
order is known at run ends, and falls by one with each step elsewhere. So long matches are intervals between samples,
as many as there are runs, and no array as long as the text is made for them. What is as long as the text while the
index is built is narrow and dropped early: a worker's memory counts with its executor's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FIRST = 7
_BLOCK = 8192


@dataclass
class RunIndex:
    text: np.ndarray  # bytes + 1, with 0 after each string
    starts: np.ndarray  # of the strings
    runs: np.ndarray  # the transform's symbol of each run
    lengths: np.ndarray  # rows of each run
    heads: np.ndarray  # text position of each run's first row
    tails: np.ndarray  # and of its last
    before: np.ndarray  # text position of the row above each head (-1: none)
    after: np.ndarray  # text position of the row below each tail (-1: none)

    def samples(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For run heads and for run tails: text positions in order, and where the match known there ends."""
        out = []
        for at, other in ((self.heads, self.before), (self.tails, self.after)):
            by = np.argsort(at)
            out.append((at[by], (at + self._common(at, other))[by]))
        return out

    def long_matches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in order and apart, of the stretches of positions whose longest match is of ``length`` or more."""
        starts, ends = [], []
        for at, end in self.samples():
            until = np.minimum(np.append(at[1:], len(self.text)), end - length + 1)  # the next sample, or the last place that reaches far enough
            keep = until > at
            starts.append(at[keep])
            ends.append(until[keep])
        start, end = np.concatenate(starts), np.concatenate(ends)
        by = np.argsort(start, kind="stable")
        start, end = start[by], np.maximum.accumulate(end[by])
        if not len(start):
            return start, end
        new = np.concatenate([[True], start[1:] > end[:-1]])
        return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest string that starts there and somewhere else too, within strings."""
        place = np.arange(len(self.text))
        best = np.zeros(len(place), np.int64)
        for at, end in self.samples():
            last = np.searchsorted(at, place, side="right") - 1
            np.maximum(best, np.where(last >= 0, end[last] - place, 0), out=best)
        return best

    def _common(self, a: np.ndarray, b: np.ndarray, step: int = 32) -> np.ndarray:
        """Common prefix lengths of the suffixes at a and b; a string's end matches nothing."""
        out = np.zeros(len(a), np.int64)
        padded = np.concatenate([self.text, np.zeros(step, self.text.dtype)])
        todo, at = np.flatnonzero(b >= 0), 0
        offsets = np.arange(step)
        while len(todo):
            nxt = []
            for lo in range(0, len(todo), _BLOCK):
                part = todo[lo : lo + _BLOCK]
                x, y = padded[(a[part] + at)[:, None] + offsets], padded[(b[part] + at)[:, None] + offsets]
                differ = (x != y) | (x == 0)
                hit = differ.any(axis=1)
                out[part] = at + np.where(hit, differ.argmax(axis=1), step)
                nxt.append(part[~hit])
            todo, at = np.concatenate(nxt), at + step
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of 0-terminated strings of symbols 1 to 256; each terminator counts as a symbol of its own, in text order."""
    n = len(text)
    wide = np.int32 if n < 2**31 - 1 else np.int64  # of places and ranks
    ends = np.flatnonzero(text == 0)
    left = np.full(n, _FIRST, np.uint8)  # symbols before the terminator, as far as the first key sees
    for i in range(_FIRST):
        own = ends - i
        left[own[own > np.append(-1, ends[:-1])]] = i
    padded = np.concatenate([text, np.zeros(_FIRST, text.dtype)])
    key = np.zeros(n, np.int64)
    for i in range(_FIRST):
        key <<= 9
        key |= padded[i : i + n] * (left > i)
    del padded
    order = np.argsort(key).astype(wide)
    ended = left[order] < _FIRST  # equal keys are then equal strings: their order, by position, is final
    del left
    key = key[order]
    at = np.flatnonzero(ended)
    order[at] = order[at][np.lexsort((order[at], key[at]))]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | ended[1:] | ended[:-1]])
    del key, ended, at
    rank = np.empty(n + 1, wide)
    rank[order], rank[n] = _first(fresh, wide), -1
    width = _FIRST
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True))).astype(wide)
    while len(tied):
        ids = order[tied]
        both = rank[ids].astype(np.int64)
        both *= n + 2
        both += rank[np.minimum(ids, max(n - width, 0)) + min(width, n)]
        both += 1
        by = np.argsort(both)
        ids, both = ids[by], both[by]
        del by
        order[tied] = ids
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        del both
        rank[ids] = tied[_first(fresh, wide)]
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    return order


def _first(fresh: np.ndarray, wide: type) -> np.ndarray:
    """For each place, the last fresh one up to it."""
    place = np.arange(len(fresh), dtype=wide)
    place *= fresh
    return np.maximum.accumulate(place, out=place)


def build(strings: list[bytes]) -> RunIndex:
    lengths = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(lengths) - lengths
    text = np.zeros(int(lengths.sum()), np.uint16)
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    text[:] = raw
    text += 1
    text[starts + lengths - 1] = 0
    order = suffix_array(text)
    last = text[order - 1].astype(order.dtype)
    last[last == 0] = -order[last == 0] - 1  # terminators differ from each other
    new = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
    end = np.concatenate([new[1:], [len(order)]]) - 1
    above = np.where(new > 0, order[np.maximum(new - 1, 0)], -1)
    below = np.where(end < len(order) - 1, order[np.minimum(end + 1, len(order) - 1)], -1)
    return RunIndex(text, starts, last[new], end - new + 1, order[new], order[end], above, below)
