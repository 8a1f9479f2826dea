"""Counts and searches over many spans of one block of rows, each in O(log rows).

A block is an array of at most two block lengths; its spans are answered
together, so every step below is one array operation over all spans.
"""

from __future__ import annotations

import numpy as np


class Extremes:
    """Sparse tables of least values: the least of a span from two overlapping powers of two, NaN if the span holds one."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 << (len(self.tables) - 1) <= len(values):
            prev, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(prev[:-half], prev[half:]))

    def least(self, start: np.ndarray, length: int) -> np.ndarray:
        """Least value of the rows start .. start + length - 1."""
        k = length.bit_length() - 1
        table = self.tables[k]
        return np.minimum(table[start], table[start + length - (1 << k)])

    def last_at_most(self, edge: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
        """Last row of the ``length`` rows up to ``end`` whose value is at most the edge; ``end`` where there is none.

        Predecessor search: walk back by halving powers of two while the rows passed are all above the edge.
        """
        at, floor = end.copy(), end - length
        for k in range(len(self.tables) - 1, -1, -1):
            back = at - (1 << k)
            inside = back >= floor
            passed = inside & (self.tables[k][np.where(inside, back + 1, 0)] > edge)
            at = np.where(passed, back, at)
        return np.where(at > floor, at, end)


def _shifted(values: np.ndarray, rows: int, fill) -> np.ndarray:
    """Every value moved ``rows`` rows down."""
    rows = min(rows, len(values))
    return np.concatenate([np.full(rows, fill, values.dtype), values[: len(values) - rows]]) if rows else values


def tiles(n: int) -> list[tuple[int, int]]:
    """(level, offset) pairs whose power-of-two windows tile the last ``n`` rows."""
    out, offset = [], 0
    for level in range(n.bit_length()):
        if n >> level & 1:
            out.append((level, offset))
            offset += 1 << level
    return out


class Frames:
    """Statistics of the last rows up to every row of one block, by doubling: a window is a union of power-of-two windows.

    ``(values, missing)`` pairs stand for nullable columns.  A missing value takes no part in an extreme and makes a sum
    missing; a window that reaches before the block is missing too.  NaN is above every number, as Spark orders it.
    """

    def __init__(self, rows: int):
        self.rows, self.levels = rows, {}

    def _level(self, key, k: int, first, double):
        """Level ``k`` of a column: its windows of 2**k rows, built from those of half the length."""
        tables = self.levels.setdefault(key, [])
        if not tables:
            tables.append(first())
        while len(tables) <= k:
            tables.append(double(tables[-1], 1 << (len(tables) - 1)))
        return tables[k]

    def count(self, values: np.ndarray, n: int) -> np.ndarray:
        """Sum of integers over the last ``n`` rows, those of the block where fewer."""
        run = np.cumsum(values)
        return run - _shifted(run, n, 0) if n else np.zeros(self.rows, np.int64)

    def missing(self, missing: np.ndarray, n: int) -> np.ndarray:
        """Where the last ``n`` rows hold a missing value or reach before the block."""
        return (self.count(missing.astype(np.int64), n) > 0) | (np.arange(self.rows) < n - 1)

    def extreme(self, key: str, values: np.ndarray, missing: np.ndarray, n: int, greatest: bool) -> tuple[np.ndarray, np.ndarray]:
        pick, fill = (np.maximum, -np.inf) if greatest else (np.fmin, np.nan)
        k = n.bit_length() - 1
        table = self._level(key, k, lambda: np.where(missing, fill, values), lambda t, half: pick(t, _shifted(t, half, fill)))
        rest = n - (1 << k)
        return pick(table, _shifted(table, rest, fill)) if rest else table, self.count((~missing).astype(np.int64), n) == 0

    def total(self, key: str, values: np.ndarray, missing: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = None
        for level, offset in tiles(n):
            part = _shifted(self._level(key, level, lambda: np.where(missing, 0.0, values), lambda t, half: t + _shifted(t, half, 0.0)), offset, 0.0)
            out = part if out is None else out + part
        return out, self.missing(missing, n)

    def deviation(self, key: str, values: np.ndarray, missing: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Population deviation of the last ``n`` values from means and squared deviations of the parts, which stays exact when all are equal.

        M2 of a union = sum of the parts' M2 + sum of size * (mean - grand mean)^2.
        """
        def double(t, half):
            (mean, m2), (before, m2_before) = t, (_shifted(x, half, 0.0) for x in t)
            return (mean + before) / 2.0, m2 + m2_before + (mean - before) ** 2 * (half / 2)

        parts = []
        for level, offset in tiles(n):
            pair = self._level(key, level, lambda: (np.where(missing, 0.0, values), np.zeros(self.rows)), double)
            parts.append((float(1 << level), *(_shifted(x, offset, 0.0) for x in pair)))
        spread = parts[0][2]
        if len(parts) > 1:
            base = parts[-1][1]
            grand = base + sum(size * (mean - base) for size, mean, _ in parts) / n
            spread = sum(m2 + size * (mean - grand) ** 2 for size, mean, m2 in parts)
        return np.sqrt(spread / n), self.missing(missing, n)


class RankCounts:
    """Wavelet matrix over value ranks: how many rows of a span lie below an edge."""

    def __init__(self, values: np.ndarray):
        self.sorted = np.sort(values)  # NaN last
        rank = np.searchsorted(self.sorted, values).astype(np.int64)
        rank[np.isnan(values)] = len(values) - 1
        self.bits = max(1, (len(values)).bit_length())
        self.zeros, self.before = [], []
        for k in range(self.bits - 1, -1, -1):
            bit = (rank >> k) & 1
            self.before.append(np.concatenate([[0], np.cumsum(1 - bit)]))  # zeros before each position
            self.zeros.append(int(self.before[-1][-1]))
            rank = np.concatenate([rank[bit == 0], rank[bit == 1]])

    def below(self, edge: np.ndarray, start: np.ndarray, end: np.ndarray, inclusive: bool) -> np.ndarray:
        """Rows start .. end - 1 with a value below the edge (or equal, if inclusive); none where the edge is NaN."""
        limit = np.searchsorted(self.sorted, edge, "right" if inclusive else "left")
        limit[np.isnan(edge)] = 0
        lo, hi, out = start.astype(np.int64), end.astype(np.int64), np.zeros(len(edge), np.int64)
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            before, zeros = self.before[level], self.zeros[level]
            zlo, zhi = before[lo], before[hi]
            one = (limit >> k) & 1 == 1
            out += np.where(one, zhi - zlo, 0)
            lo, hi = np.where(one, zeros + lo - zlo, zlo), np.where(one, zeros + hi - zhi, zhi)
        return out


class Touches:
    """Zone touches and midline crosses of one block: low, high and close in row order."""

    def __init__(self, low: np.ndarray, high: np.ndarray, close: np.ndarray):
        self.lows, self.negative_highs = Extremes(low), Extremes(-high)
        self.low_counts, self.high_counts = RankCounts(low), RankCounts(-high)
        # a step crosses a level strictly between its two closes; a flat step, or one with a NaN, crosses none
        a, b = close[:-1], close[1:]
        moves = (a < b) | (a > b)
        out_of_reach = np.inf
        self.step_low = RankCounts(np.where(moves, np.minimum(a, b), out_of_reach))
        self.step_high = RankCounts(np.where(moves, np.maximum(a, b), out_of_reach))

    def of(self, end: np.ndarray, length: int, lower: float, upper: float) -> dict[str, np.ndarray]:
        """For the windows of ``length`` rows that end at the given rows; last touches are rows of the block."""
        start = end - length + 1
        bottom, top = self.lows.least(start, length), -self.negative_highs.least(start, length)
        span = top - bottom
        low_edge, high_edge, mid = bottom + lower * span, top - upper * span, bottom + 0.5 * span
        return {
            "touches_lower_zone": self.low_counts.below(low_edge, start, end + 1, True),
            "touches_upper_zone": self.high_counts.below(-high_edge, start, end + 1, True),
            "midline_crosses": self.step_low.below(mid, start, end, False) - self.step_high.below(mid, start, end, True),
            "last_lower": self.lows.last_at_most(low_edge, end, length),
            "last_upper": self.negative_highs.last_at_most(-high_edge, end, length),
        }
