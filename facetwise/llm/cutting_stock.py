"""The cutting-stock problem by column generation, over a histogram of lengths, where pieces may be cut too.

Bins of `capacity` units are to hold n_c pieces of c units each, for every c, in as few bins as will do. The linear
program's columns are patterns, the multisets of pieces that fit a bin, and cuts, which make two pieces of one, at a
multiple of `step` units. It starts with one pattern for each length; the duals then price the lengths, a knapsack
by dynamic programming finds the pattern of most value, a look at all pairs finds the cut that gains most, and the
revised simplex method takes the better one in, until nothing is gained or the bins are within GAP of what the
pieces fill. Numbers are rounded down; the pieces that leaves, some for each pattern, are packed best-fit decreasing, and
where that leaves room, end to end with cuts. Work and memory depend on the capacity alone, not on the number of pieces.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: The simplex method ends within GAP; after SOME_COLUMNS within FAIR; after MOST_COLUMNS anyway.
GAP, FAIR, SOME_COLUMNS, MOST_COLUMNS = 5e-4, 1e-2, 2500, 10_000
#: What a cut costs, in bins, so that none is made for nothing.
CUT = 2e-3
#: Every length gets this part of the mean number of pieces more, unevenly, so that steps of the simplex method move.
MORE = 1e-3


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack. values[c - 1]: of a piece of c units."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for room in range(1, capacity + 1):
        worth = values[:room] + best[room - 1 :: -1]  # a piece of c units and the best for what is left
        j = int(worth.argmax())
        best[room], choice[room] = (worth[j], j + 1) if worth[j] > best[room - 1] else (best[room - 1], 0)
    pattern, room = np.zeros(capacity), capacity
    while room > 0:
        if c := choice[room]:
            pattern[c - 1] += 1
        room -= c or 1
    return float(best[capacity]), pattern


def best_cut(values: np.ndarray, capacity: int, step: int) -> tuple[float, int, int]:
    """(gain, length, units cut off) of the cut that gains most at these prices."""
    c, j = np.arange(1, capacity + 1)[:, None], np.arange(step, capacity, step)[None, :]
    gain = np.where(j < c, values[c - 1] - values[j - 1] - values[np.maximum(c - j, 1) - 1], -np.inf)
    if not gain.size:
        return -np.inf, 0, 0
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1] + 1, (at % gain.shape[1] + 1) * step


def relax(counts: np.ndarray, capacity: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linear program's basis: its columns, what each costs, how often each is used. counts[c - 1]: pieces of c units."""
    sizes = np.arange(1, capacity + 1)
    counts = counts + MORE * counts.sum() / capacity * (1 + sizes * 0.618034 % 1)
    fold = (capacity // sizes).astype(float)
    columns, inverse, cost = np.diag(fold), np.diag(1 / fold), np.ones(capacity)
    used, filled = counts / fold, float(counts @ sizes) / capacity
    for i in range(MOST_COLUMNS):
        if cost @ used <= filled * (1 + (GAP if i < SOME_COLUMNS else FAIR)):
            break
        duals = cost @ inverse
        worth, column = price(duals, capacity)
        gain, length, off = best_cut(duals, capacity, step)
        new = 1.0
        if gain - CUT > worth - 1:
            column, new, worth = np.zeros(capacity), CUT, gain
            column[length - 1] += 1
            column[off - 1] -= 1
            column[length - off - 1] -= 1
        if worth - new <= 1e-9:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-10, used / np.where(change > 1e-10, change, 1), np.inf)
        leaving = int(ratio.argmin())
        much = ratio[leaving]
        if not np.isfinite(much):
            break
        used = np.maximum(used - much * change, 0)
        used[leaving] = much
        row = inverse[leaving] / change[leaving]
        inverse -= np.outer(change, row)
        inverse[leaving] = row
        columns[:, leaving], cost[leaving] = column, new
    return columns, cost, used


def best_fit(pieces: list[int], capacity: int) -> list[list[int]]:
    """Bins of pieces: each piece, the largest first, into the fullest bin that has room."""
    bins, by_room = [], [[] for _ in range(capacity + 1)]
    for c in sorted(pieces, reverse=True):
        room = next((r for r in range(c, capacity + 1) if by_room[r]), None)
        if room is None:
            bins.append([])
            b, room = len(bins) - 1, capacity
        else:
            b = by_room[room].pop()
        bins[b].append(c)
        by_room[room - c].append(b)
    return bins


def end_to_end(pieces: list[int], capacity: int, step: int) -> tuple[list[list[int]], Counter]:
    """Bins of pieces laid one after another, cut where a bin ends; and the cuts (length, units cut off)."""
    bins, cuts, room = [], Counter(), 0
    for c in sorted(pieces, reverse=True):
        while c:
            if c <= room:
                bins[-1].append(c)
                room, c = room - c, 0
            elif off := room // step * step:
                cuts[c, off] += 1
                bins[-1].append(off)
                room, c = 0, c - off
            else:
                bins.append([])
                room = capacity
    return bins, cuts


def solve(histogram: dict[int, int], capacity: int, step: int, slack: int = 2) -> tuple[dict[tuple[int, int], int], list[tuple[dict[int, int], int]]]:
    """Cuts {(length, units cut off): how many} and bins [(pieces by length, number of bins)].

    The cuts, made from the longest pieces down, turn the histogram's pieces into just those of the bins.
    slack: units that a bin of the last pieces may leave empty before its pieces are cut.
    """
    if not histogram:
        return {}, []
    if min(histogram) < 1 or max(histogram) > capacity:
        raise ValueError("lengths go from 1 to the capacity")
    left = np.zeros(capacity, np.int64)
    for c, n in histogram.items():
        left[c - 1] = n
    cuts, bins = Counter(), []
    columns, cost, used = relax(left.astype(float), capacity, step)
    made = [(int(np.flatnonzero(columns[:, j] > 0)[0]) + 1, j) for j in range(capacity) if cost[j] < 1 and used[j] >= 1]
    for c, j in sorted(made, reverse=True):
        if (n := min(int(used[j] + 1e-6), int(left[c - 1]))) > 0:
            parts = np.flatnonzero(columns[:, j] < 0) + 1
            off = next(int(p) for p in parts if p % step == 0)
            cuts[c, off] += n
            left[c - 1] -= n
            left[off - 1] += n
            left[c - off - 1] += n
    for j in np.argsort(-used):
        pattern = columns[:, j].astype(np.int64)
        some = np.flatnonzero(pattern)
        if cost[j] == 1 and len(some) and (n := min(int(used[j] + 1e-6), int((left[some] // pattern[some]).min()))) > 0:
            left -= n * pattern
            bins.append(({int(i) + 1: int(pattern[i]) for i in some}, n))
    fitted = best_fit(np.repeat(np.arange(1, capacity + 1), left).tolist(), capacity)
    full = [b for b in fitted if capacity - sum(b) <= slack]
    others, more = end_to_end([c for b in fitted if capacity - sum(b) > slack for c in b], capacity, step)
    rest = Counter(tuple(sorted(Counter(b).items())) for b in full + others)
    return dict(cuts + more), bins + [(dict(b), k) for b, k in sorted(rest.items())]
