"""Cuts at the root of a mixed-integer search: Gomory's from rows of the final tableau, and covers of knapsack rows.

Every cut is a row ``a x >= least`` over the problem's columns that holds for all integer solutions and that the
relaxation's solution breaks.
"""

from __future__ import annotations

import numpy as np

from feederflow.plans.basis import Columns, Factors

INF = float("inf")
MOST = 30  # cuts in a round
DYNAMIC = 1e6  # the largest ratio of a cut's coefficients
AWAY = 0.01  # how far a basic value must be from whole


def _tidy(a: np.ndarray, least: float, x: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, float] | None:
    """A cut scaled to 1 without its dust, if it is sound to compute with and ``x`` breaks it; dust moves to the side that keeps it valid."""
    top = np.abs(a).max(initial=0.0)
    if not np.isfinite(top) or not np.isfinite(least) or top < 1e-9:
        return None
    a, least = a / top, least / top
    dust = (np.abs(a) > 0) & (np.abs(a) < 1 / DYNAMIC)
    most = np.where(a[dust] > 0, upper[dust], lower[dust])
    if not np.isfinite(most).all():
        return None
    least -= float(a[dust] @ most)
    a = np.where(dust, 0.0, a)
    norm = np.linalg.norm(a)
    return (a, least - 1e-9) if norm > 0 and least - a @ x > 1e-6 * norm else None


def gomory(p, s, integer: np.ndarray, tolerance: float) -> list[tuple[np.ndarray, float]]:
    """Mixed-integer cuts of the rows whose basic variable should be whole.

    A nonbasic variable is measured from the bound where it rests; slacks are whole only if their rows are, which
    is not looked into, so they count as continuous.
    """
    if s.basis is None:
        return []
    columns = Columns.of(p.a)
    m, n = columns.shape
    head, x = s.basis
    lower, upper = np.concatenate([p.lower, p.row_lower]), np.concatenate([p.upper, p.row_upper])
    whole = np.concatenate([integer, np.zeros(m, bool)])
    f = Factors(m, [columns.column(j) if j < n else (np.array([j - n]), np.array([-1.0])) for j in head.tolist()])
    if not f.ok:
        return []
    basic = np.zeros(n + m, bool)
    basic[head] = True
    out = []
    parts = x[head] - np.floor(x[head])
    ranked = np.argsort(np.abs(parts - 0.5))
    for r in ranked.tolist():
        j, f0 = head[r], parts[r]
        if len(out) >= MOST or not whole[j] or not AWAY < f0 < 1 - AWAY:
            continue
        unit = np.zeros(m)
        unit[r] = 1.0
        y = f.row_of(unit)
        row = np.concatenate([columns.dual(y), -y])
        row[basic | (upper - lower <= 0) | (np.abs(row) < 1e-12)] = 0.0
        used = np.flatnonzero(row)
        at_upper = np.isfinite(upper[used]) & (np.abs(x[used] - upper[used]) <= np.abs(x[used] - lower[used]))
        rest = np.where(at_upper, upper[used], lower[used])
        if not np.isfinite(rest).all():  # a free variable moves both ways
            continue
        # x_j + sum(row * x) = const; with t >= 0 from the bound the coefficient turns round at an upper one.
        g = np.where(at_upper, -row[used], row[used])
        part = g - np.floor(g)
        moved = whole[used] & (np.abs(rest - np.round(rest)) < tolerance)
        c = np.where(moved, np.where(part <= f0, part / f0, (1 - part) / (1 - f0)), np.where(g >= 0, g / f0, -g / (1 - f0)))
        # sum(c * t) >= 1, with t = x - lower or upper - x, and slacks as the rows that they are.
        sign = np.where(at_upper, -c, c)
        least = 1.0 + float(sign @ rest)
        a = np.zeros(n)
        own = used < n
        a[used[own]] = sign[own]
        slack = np.zeros(m)
        slack[used[~own] - n] = sign[~own]
        a += columns.dual(slack)
        cut = _tidy(a, least, x[:n], p.lower, p.upper)
        if cut is not None:
            out.append(cut)
    return out


def covers(p, s, integer: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Of a row ``sum(w x) <= c`` over binaries, a set that does not fit together: not all of it can be on.

    Other columns of the row take the value that leaves most room; a negative weight stands for its complement.
    """
    columns = Columns.of(p.a)
    m, n = columns.shape
    binary = integer & (p.lower == 0) & (p.upper == 1)
    rows: dict[int, list[tuple[int, float]]] = {}
    for j, i, v in zip(columns.column_of.tolist(), columns.index.tolist(), columns.value.tolist(), strict=True):
        rows.setdefault(i, []).append((j, v))
    x, out = s.x, []
    for i, entries in rows.items():
        for sign, limit in ((1.0, p.row_upper[i]), (-1.0, -p.row_lower[i])):
            if len(out) >= MOST or not np.isfinite(limit):
                continue
            room, items = float(limit), []
            for j, v in entries:
                w = sign * v
                if binary[j]:
                    room -= min(w, 0.0)
                    items.append((x[j] if w > 0 else 1 - x[j], abs(w), j, w > 0))
                else:
                    room -= w * (p.lower[j] if w > 0 else p.upper[j])
            if len(items) < 2 or not np.isfinite(room) or room < 0:
                continue
            took, weight = [], 0.0
            for item in sorted(items, key=lambda t: (1 - t[0]) / t[1]):  # what is nearly on and heavy first
                took.append(item)
                weight += item[1]
                if weight > room + 1e-9:
                    break
            else:
                continue
            for item in sorted(took, key=lambda t: t[0]):  # without those that it does not need, the least on first
                if weight - item[1] > room + 1e-9:
                    weight -= item[1]
                    took.remove(item)
            a, least = np.zeros(n), -(len(took) - 1.0)
            for _, _, j, plain in took:
                a[j] = -1.0 if plain else 1.0
                least += 0.0 if plain else 1.0
            if least - a @ x > 1e-6:
                out.append((a, least))
    return out


def at_root(p, s, integer: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The cuts that a relaxation's solution breaks, as dense rows and their least values."""
    found = gomory(p, s, integer, tolerance) + covers(p, s, integer)
    n = p.a.shape[1]
    return np.array([a for a, _ in found]).reshape(-1, n), np.array([least for _, least in found])
