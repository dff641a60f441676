"""What two sequences share: repeatedly the longest common run, the earliest in the first and then in the second among equals."""
from __future__ import annotations

import numpy as np

#: Cells of a table of equal codes, at most; runs that are split as a list rather than as arrays.
TABLE, FEW = 4_000_000, 128


def _ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Level k numbers the runs of 2 ** k codes: equal numbers mean equal runs, without hashing."""
    levels = [codes.astype(np.int64)]
    while (width := 1 << len(levels)) <= len(codes):
        last = levels[-1]
        pair = last[: len(codes) - width + 1] * (int(last.max()) + 1) + last[width // 2 : width // 2 + len(codes) - width + 1]
        levels.append(np.unique(pair, return_inverse=True)[1])
    return levels


class Runs:
    """Common runs of two sequences of codes, from numbered runs of powers of two: any length is two of them that overlap."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.b_at = len(a)
        self.levels = _ranks(np.concatenate([a, b]))

    def _keys(self, start: int, end: int, n: int) -> np.ndarray:
        """A number for each run of ``n`` codes within places ``start`` to ``end``."""
        level = self.levels[n.bit_length() - 1]
        width, count = 1 << (n.bit_length() - 1), end - start - n + 1
        left, right = level[start : start + count], level[start + n - width : start + n - width + count]
        return left * (int(level.max()) + 1) + right

    def longest(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """(place in a, place in b, length) of the longest common run within a[a0:a1] and b[b0:b1]."""
        low, high = 0, min(a1 - a0, b1 - b0)
        shift = self.b_at
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(self._keys(a0, a1, n), self._keys(shift + b0, shift + b1, n)).any():
                low = n
            else:
                high = n - 1
        if low == 0:
            return a0, b0, 0
        ours, theirs = self._keys(a0, a1, low), self._keys(shift + b0, shift + b1, low)
        i = int(np.isin(ours, theirs).argmax())
        return a0 + i, b0 + int((theirs == ours[i]).argmax()), low


def _diagonals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, length) of every common run that can't be made longer, from the table of equal codes."""
    deep, width = len(a) + 1, len(a) + len(b) + 1
    table = np.zeros((deep, width), dtype=bool)
    table[:-1, : len(b)] = a[:, None] == b
    table = np.append(table.ravel(), np.zeros(deep, dtype=bool)).reshape(deep, width + 1).T  # now a row is a diagonal, with no room left to wrap
    flat = np.concatenate(([False], table.ravel(), [False]))
    edge = np.flatnonzero(flat[1:] != flat[:-1])
    diagonal, i = np.divmod(edge[::2], deep)
    cell = i * (width + 1) + diagonal
    return cell // width, cell % width, edge[1::2] - edge[::2]


def _few(runs: list[tuple[int, int, int]], out: np.ndarray) -> None:
    """The rule of :func:`changed` for few runs."""
    todo = [runs]
    while todo:
        runs = todo.pop()
        top, i, j = max((n, -i, -j) for i, j, n in runs)
        i, j = -i, -j
        out[j : j + top] = False
        before, after, i1, j1 = [], [], i + top, j + top
        for x, y, n in runs:
            m = min(n, i - x, j - y)
            if m > 0:
                before.append((x, y, m))
            s = max(0, i1 - x, j1 - y)
            if s < n:
                after.append((x + s, y + s, n - s))
        if before:
            todo.append(before)
        if after:
            todo.append(after)


def _small(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """:func:`changed` where the table of equal codes fits: its runs, cut to what lies on either side of each match."""
    span = len(b) + 1
    todo = [_diagonals(a, b)]
    while todo:
        i, j, n = todo.pop()
        if len(n) <= FEW:
            if len(n):
                _few(list(zip(i.tolist(), j.tolist(), n.tolist(), strict=True)), out)
            continue
        k = int(np.argmax(n * (span * (len(a) + 1)) - i * span - j))
        x, y, top = int(i[k]), int(j[k]), int(n[k])
        out[y : y + top] = False
        m = np.minimum(n, np.minimum(x - i, y - j))
        s = np.maximum(0, np.maximum(x + top - i, y + top - j))
        for length, skip in ((m, None), (n - s, s)):
            some = np.flatnonzero(length > 0)
            todo.append((i[some], j[some], length[some]) if skip is None else (i[some] + skip[some], j[some] + skip[some], length[some]))


def changed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each code of ``b``: not part of a run that matches ``a``, the longest first and then what lies on either side of it.

    Up to :data:`TABLE` pairs of places all runs are listed once; longer sequences number their runs and search by length.
    """
    out = np.ones(len(b), dtype=bool)
    if not len(a) or not len(b):
        return out
    if (len(a) + 1) * (len(a) + len(b) + 1) <= TABLE:
        _small(a, b, out)
        return out
    runs, left = Runs(a, b), [(0, len(a), 0, len(b))]
    while left:
        a0, a1, b0, b1 = left.pop()
        i, j, n = runs.longest(a0, a1, b0, b1)
        if n:
            out[j : j + n] = False
            left += [(x0, x1, y0, y1) for x0, x1, y0, y1 in ((a0, i, b0, j), (i + n, a1, j + n, b1)) if x0 < x1 and y0 < y1]
    return out


def coded(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of items as codes of one numbering."""
    number: dict[str, int] = {}
    every = np.array([number.setdefault(x, len(number)) for x in [*a, *b]], dtype=np.int64)
    return every[: len(a)], every[len(a) :]
