"""A suffix sort that compares by hashes, for texts that were cut to where they may repeat.

Prefix polynomial hashes give the hash of any slice at once, so the common extension of two suffixes
is found by binary search and a comparison costs a logarithm of its length. A merge sort over all
suffixes runs level by level: each finds its rank in the sibling run by binary search. Neighbours
that agree in their first ``length`` bytes are repeats; their bytes are compared before they count.
"""

from __future__ import annotations

import numpy as np

from .textbuf import BYTE, INVERSE, U64, mix, powers, prefix_hashes, slice_hashes

VERIFY_ROWS = 4096


def anchors(data: np.ndarray, length: int, gram: int, part: int = 1 << 20, most: int = 1 << 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` bytes with one least ``gram`` hash: hash, first window, windows, again.

    Equal windows have equal least hashes wherever they stand, so windows of different hashes never
    repeat each other. ``again`` is 1 where the gram stands twice in the part, so that windows of one
    run may repeat each other, and of runs cut at ``most`` windows. Long texts are worked on in parts.
    """
    total, keys, firsts, counts, again = len(data) - length + 1, [], [], [], []
    for a in range(0, max(total, 0), part):
        piece = data[a : min(a + part, total) + length - 1]
        prefix = prefix_hashes(BYTE[piece])
        starts = np.arange(len(piece) - gram + 1)
        h = mix(slice_hashes(prefix, starts, starts + gram))
        wide, n = length - gram + 1, len(piece) - length + 1
        padded = np.full(-(-len(h) // wide) * wide, U64(0xFFFFFFFFFFFFFFFF))
        padded[: len(h)] = h
        rows = padded.reshape(-1, wide)
        upto = np.minimum.accumulate(rows, 1).ravel()
        onward = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(onward[:n], upto[wide - 1 : wide - 1 + n])
        at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        wide_runs = np.diff(np.append(at, n))
        cuts = -(-wide_runs // most)  # a run of more windows is several
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = np.repeat(at, cuts) + nth * most
        keys.append(least[at])
        firsts.append(at + a)
        counts.append(np.diff(np.append(at, n)))
        known = np.sort(keys[-1])
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        times = np.bincount(place[known[place] == h], minlength=len(known))
        again.append(times[np.searchsorted(known, keys[-1])] > 1)
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts), np.concatenate(again)


class Suffixes:
    """Suffixes of a buffer, compared over their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = prefix_hashes(BYTE[data])
        self.inverse = powers(INVERSE, len(data) + 1)

    def hashes(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.prefix[at + n] - self.prefix[at]) * self.inverse[at]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes from ``i`` and ``j`` on, up to ``length``, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.length)
        same = self.whole[i] == self.whole[j] if self.whole is not None else self.hashes(i, self.length) == self.hashes(j, self.length)
        low[same] = self.length
        open_ = np.flatnonzero(~same)
        while len(open_):
            a, b = low[open_], high[open_]
            middle = (a + b) >> 1
            equal = self.hashes(i[open_], middle + 1) == self.hashes(j[open_], middle + 1)
            low[open_], high[open_] = np.where(equal, middle + 1, a), np.where(equal, b, middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    whole = None

    def before(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix ``i`` stands before ``j``; ``ties`` where they agree."""
        n = self.extension(i, j)
        equal = n >= self.length
        m = np.where(equal, 0, n)
        return np.where(equal, ties, self.data[i + m] < self.data[j + m])

    def sort(self, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """An order of ``starts`` by suffix within each segment (``segment`` is sorted)."""
        n = len(starts)
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, n))
        base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        order = np.arange(n)
        width = 1
        while n and width < sizes.max():
            spot = np.flatnonzero(size > width)
            place = spot - base[spot]
            run = place // width
            begin = (run ^ 1) * width
            end = np.minimum(begin + width, size[spot])
            some = begin < end
            spot, place, run, begin, end = spot[some], place[some], run[some], begin[some], end[some]
            right = (run & 1).astype(bool)
            low, high, own = begin.copy(), end.copy(), starts[order[spot]]
            while len(live := np.flatnonzero(low < high)):
                middle = (low[live] + high[live]) >> 1
                other = starts[order[base[spot[live]] + middle]]
                less = self.before(other, own[live], right[live])  # of equal ones the left run's go first
                low[live], high[live] = np.where(less, middle + 1, low[live]), np.where(less, high[live], middle)
            target = base[spot] + (run & ~1) * width + (place - run * width) + (low - begin)
            moved = order.copy()
            moved[target] = order[spot]
            order = moved
            width *= 2
        return order

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the bytes themselves agree over ``length``."""
        rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        out = np.empty(len(i), bool)
        for a in range(0, len(i), VERIFY_ROWS):
            b = a + VERIFY_ROWS
            out[a:b] = (rows[i[a:b]] == rows[j[a:b]]).all(1)
        return out


def repeated(contexts: list[bytes], keys: np.ndarray, alone: np.ndarray, length: int, gram: int) -> list[list[tuple[int, int]]]:
    """Ranges of windows of each context that stand in another one, or elsewhere in the same.

    ``keys`` are the anchors' hashes; only contexts of one key can repeat each other, and only at the
    same distance to the anchor's first place in the window: these are the sort's segments. Contexts
    that are not ``alone`` are repeats as a whole and here serve as partners only.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    s = Suffixes(data, length)
    places = np.arange(len(data) - gram + 1)
    ends = np.repeat(begins + sizes, sizes)[: len(places)]
    hit = (mix(s.hashes(places, gram)) == np.repeat(keys, sizes)[: len(places)]) & (places + gram <= ends)
    found = np.flatnonzero(hit)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begins, windows)
    shift = found[np.minimum(np.searchsorted(found, starts), len(found) - 1)] - starts
    _, group = np.unique(keys, return_inverse=True)
    segment = group[owner] * (length + 1) + np.clip(shift, 0, length)
    _, of, count = np.unique(segment, return_inverse=True, return_counts=True)
    wanted = np.bincount(of, weights=alone[owner]) > 0
    use = np.flatnonzero((count > 1)[of] & wanted[of])
    use = use[np.argsort(of[use], kind="stable")]
    if not len(use):
        return out
    s.whole = np.zeros(len(data), U64)
    s.whole[starts[use]] = s.hashes(starts[use], length)
    use = use[s.sort(starts[use], of[use])]
    left, right = use[:-1], use[1:]
    near = (of[left] == of[right]) & (s.whole[starts[left]] == s.whole[starts[right]])
    left, right = left[near], right[near]
    true = s.agree(starts[left], starts[right])
    marked = np.zeros(len(starts), bool)
    marked[left[true]] = marked[right[true]] = True
    for g in np.unique(of[left[~true]]):  # unequal bytes of equal hash: decide this segment by the bytes
        mine = np.flatnonzero(of == g)
        texts = [data[starts[w] : starts[w] + length].tobytes() for w in mine]
        seen: dict[bytes, int] = {}
        for t in texts:
            seen[t] = seen.get(t, 0) + 1
        marked[mine] = [seen[t] > 1 for t in texts]
    marked &= alone[owner]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    first_window = np.cumsum(windows) - windows
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        while a < b:  # a run may go on into the next context
            c = owner[a]
            end = min(b, int(first_window[c] + windows[c]))
            out[c].append((int(a - first_window[c]), int(end - first_window[c])))
            a = end
    return out
