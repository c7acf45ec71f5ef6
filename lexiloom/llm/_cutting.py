"""Cutting-stock by column generation on a length histogram.

The histogram has at most `capacity` entries however large the corpus is, so
the linear program's size is fixed. Columns are priced by an unbounded-knapsack
dynamic program over the dual values; the program stops when the Farley bound
proves the solution to be within `gap` of the optimum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _price(y: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: largest dual value of a pattern of exactly c tokens; pick[c]: an item of it."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    pick = np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        if k:
            v = best[c - lengths[:k]] + y[:k]
            j = int(np.argmax(v))
            best[c], pick[c] = v[j], j
    return best, pick


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.001, rounds: int = 6000) -> list[tuple[dict[int, int], float]]:
    """Patterns (length -> copies) with fractional multiplicities: as few sequences as cover the demand exactly."""
    lengths, m = np.asarray(lengths, np.int64), len(lengths)
    if not m:
        return []
    fit = capacity // lengths
    columns = [{int(l): int(f)} for l, f in zip(lengths, fit)]
    inverse = np.diag(1.0 / fit)
    x = inverse @ np.asarray(demand, float)
    index = {int(l): i for i, l in enumerate(lengths)}
    for _ in range(rounds):
        best, pick = _price(inverse.sum(axis=0), lengths, capacity)
        c = int(np.argmax(best))
        if best[c] <= 1 + gap:  # the optimum is at least the present value divided by this
            break
        pattern: dict[int, int] = {}
        column = np.zeros(m)
        while c > 0:
            l = int(lengths[pick[c]])
            pattern[l] = pattern.get(l, 0) + 1
            column[index[l]] += 1
            c -= l
        d = inverse @ column
        up = d > 1e-9
        steps = np.full(m, np.inf)
        steps[up] = np.maximum(x[up], 0) / d[up]
        r = int(np.argmin(steps))
        step = steps[r]
        x -= step * d
        x[r] = step
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        columns[r] = pattern
    return [(p, float(v)) for p, v in zip(columns, x) if v > 1e-9]


def plan(lengths: Sequence[int], demand: Sequence[int], capacity: int, **options) -> list[tuple[dict[int, int], int]]:
    """Whole patterns (length -> copies, times) that use every piece once: the rounded program, then best fit for the rest."""
    left = {int(l): int(n) for l, n in zip(lengths, demand)}
    out = []
    for pattern, times in sorted(column_generation(np.array(lengths), np.array(demand), capacity, **options), key=lambda p: -p[1]):
        whole = min([int(times + 1e-6), *(left[l] // n for l, n in pattern.items())])
        if whole > 0:
            out.append((pattern, whole))
            for l, n in pattern.items():
                left[l] -= n * whole
    bins: list[dict[int, int]] = []
    free: dict[int, list[int]] = {}
    for l in sorted((l for l, n in left.items() for _ in range(n)), reverse=True):
        room = next((r for r in range(l, capacity + 1) if free.get(r)), None)
        if room is None:
            bins.append({})
            k, room = len(bins) - 1, capacity
        else:
            k = free[room].pop()
        bins[k][l] = bins[k].get(l, 0) + 1
        free.setdefault(room - l, []).append(k)
    return out + [(b, 1) for b in bins]
