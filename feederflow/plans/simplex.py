"""A bounded simplex for ranged rows, and branch and bound with cuts on top of it: one model in one task.

Rows ``lower <= A x <= upper`` become ``A x - s = 0`` with a bounded slack, so the slacks are a first basis. The
first phase lowers the sum by which basic variables miss their bounds; any basis may start it, which is how a node
of the search starts from its parent's. After many steps without progress the choice follows the smallest
index, so the method cannot cycle. The matrix stays sparse; a large basis is kept in triangular factors.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from feederflow.plans import cuts
from feederflow.plans.basis import Columns, Factors, Inverse

INF = float("inf")


@dataclass(frozen=True)
class Options:
    iterations: int = 200_000
    dual_tolerance: float = 1e-9
    primal_tolerance: float = 1e-8
    pivot_tolerance: float = 1e-9
    refactor: int = 256
    stall: int = 200
    dense_rows: int = 150  # up to so many rows the basis is a dense inverse
    etas: int = 64  # after so many steps sparse factors are made anew


@dataclass(frozen=True)
class Problem:
    a: np.ndarray | Columns  # rows x columns
    lower: np.ndarray
    upper: np.ndarray
    obj: np.ndarray
    row_lower: np.ndarray
    row_upper: np.ndarray


@dataclass
class Solution:
    status: str  # optimal, infeasible, unbounded, limit, failed
    objective: float
    x: np.ndarray
    dual: np.ndarray
    iterations: int = 0
    basis: tuple | None = field(default=None, repr=False)


def _start(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Nonbasic variables rest at the bound nearest to 0, free ones at 0."""
    low, high = np.where(np.isfinite(lower), lower, -INF), np.where(np.isfinite(upper), upper, INF)
    return np.clip(0.0, low, high)


def solve(p: Problem, o: Options = Options(), basis: tuple | None = None) -> Solution:
    m, n = p.a.shape
    a = Columns.of(p.a)
    lower, upper = np.concatenate([p.lower, p.row_lower]), np.concatenate([p.upper, p.row_upper])
    cost = np.concatenate([p.obj, np.zeros(m)])
    if (lower > upper + o.primal_tolerance).any():
        return Solution("infeasible", 0.0, np.zeros(n), np.zeros(m))
    if basis is None:
        head, x = np.arange(n, n + m), _start(lower, upper)
    else:
        head, x = basis[0].copy(), np.clip(basis[1], lower, upper)
    basic = np.zeros(n + m, bool)
    basic[head] = True
    small = m <= o.dense_rows
    refactor = o.refactor if small else min(o.refactor, o.etas)

    def entries(j: int) -> tuple[np.ndarray, np.ndarray]:
        """A column of ``[A, -I]``."""
        return a.column(j) if j < n else (np.array([j - n]), np.array([-1.0]))

    def image(v: np.ndarray) -> np.ndarray:
        return a.times(v[:n]) - v[n:]

    def factor() -> Inverse | Factors | None:
        """New factors of the basis, and the basic variables from them."""
        f = (Inverse if small else Factors)(m, [entries(j) for j in head.tolist()])
        if not f.ok:
            return None
        x[head] = 0
        x[head] = -f.column(image(x))
        return f

    fixed = upper - lower <= 0
    count = stall = 0

    f = factor()
    if f is None:
        return solve(p, o) if basis is not None else Solution("failed", 0.0, np.zeros(n), np.zeros(m))
    fresh = True
    while True:
        xb, lb, ub = x[head], lower[head], upper[head]
        low, high = xb < lb - o.primal_tolerance, xb > ub + o.primal_tolerance
        first = bool(low.any() or high.any())
        cb = high.astype(float) - low if first else cost[head]
        y = f.row_of(cb)
        d = (0.0 if first else cost) - np.concatenate([a.dual(y), -y])
        d[basic | fixed] = 0
        up = (x < upper) & (d < -o.dual_tolerance)
        down = (x > lower) & (d > o.dual_tolerance)
        can = np.flatnonzero(up | down)
        if not len(can):
            if not fresh:
                f = factor()
                if f is None:
                    return Solution("failed", 0.0, x[:n], np.zeros(m), count)
                fresh = True
                continue
            off = np.maximum(lower[head] - x[head], x[head] - upper[head]).max(initial=0.0)
            if not first and off > 1e3 * o.primal_tolerance:
                return Solution("failed", float(p.obj @ x[:n]), x[:n], np.zeros(m), count)
            if first:
                return Solution("infeasible", float(p.obj @ x[:n]), x[:n], np.zeros(m), count)
            return Solution("optimal", float(p.obj @ x[:n]), x[:n].copy(), y.copy(), count, (head.copy(), x.copy()))
        if count >= o.iterations:
            return Solution("limit", float(p.obj @ x[:n]), x[:n], np.zeros(m), count)
        j = int(can[0]) if stall > o.stall else int(can[np.abs(d[can]).argmax()])
        way = 1.0 if up[j] else -1.0
        own = np.zeros(m)
        at, value = entries(j)
        own[at] = value
        w = f.column(own)
        move = -way * w  # change of the basics for a unit step
        # How far each basic lets the step go; one that misses a bound stops at the bound it reaches on its way back.
        to = np.where(move > 0, np.where(low, lb, ub), np.where(high, ub, lb))
        blocked = (np.abs(move) > o.pivot_tolerance) & np.isfinite(to) & ~(low & (move < 0)) & ~(high & (move > 0))
        step = np.full(m, INF)
        step[blocked] = np.maximum((to[blocked] - xb[blocked]) / move[blocked], 0.0)
        span = upper[j] - lower[j]
        least = step.min(initial=INF)
        if min(least, span) == INF:
            return Solution("unbounded", -INF, x[:n], np.zeros(m), count)
        count += 1
        stall = stall + 1 if min(least, span) <= 1e-12 else 0
        if span <= least:
            x[head] = xb + move * span
            x[j] = upper[j] if way > 0 else lower[j]
            continue
        near = np.flatnonzero(step <= least + 1e-12)
        r = int(near[head[near].argmin()]) if stall > o.stall else int(near[np.abs(move[near]).argmax()])
        x[head] = xb + move * least
        x[j] += way * least
        out = head[r]
        x[out] = to[r]
        f.replace(r, w)
        head[r] = j
        basic[out], basic[j] = False, True
        fresh = False
        if count % refactor == 0:
            f = factor()
            if f is None:
                return Solution("failed", 0.0, x[:n], np.zeros(m), count)
            fresh = True


@dataclass(frozen=True)
class MipOptions:
    nodes: int = 5_000
    integrality: float = 1e-6
    gap: float = 1e-6
    lp: Options = Options()
    cut_rounds: int = 0  # rounds of cuts at the root; each counts as a node


@dataclass
class MipSolution:
    best: Solution
    nodes: int
    proved: bool
    bound: float


def solve_mip(p: Problem, integer: np.ndarray, o: MipOptions = MipOptions()) -> MipSolution:
    """Depth first, the nearer side of a branch first; the variable by pseudo-costs. Duals are those of the incumbent's
    relaxation with its integers fixed, for the problem's own rows. A node whose relaxation does not end leaves the
    search unproved. Cuts, where asked for, are added at the root as long as they raise its bound."""
    at = np.flatnonzero(integer)
    rows = p.a.shape[0]
    root = solve(p, o.lp)
    if root.status != "optimal" or not len(at):
        return MipSolution(root, 1, root.status in ("optimal", "infeasible", "unbounded"), root.objective)
    nodes = 0
    for _ in range(o.cut_rounds):
        new, least = cuts.at_root(p, root, integer, o.integrality)
        if not len(new):
            break
        tried = replace(p, a=Columns.of(p.a).with_rows(new), row_lower=np.concatenate([p.row_lower, least]), row_upper=np.concatenate([p.row_upper, np.full(len(new), INF)]))
        again = solve(tried, o.lp)
        nodes += 1
        if again.status != "optimal" or again.objective <= root.objective + 1e-9 * max(1.0, abs(root.objective)):
            break
        p, root = tried, again
    gain, seen = np.zeros((2, len(at))), np.zeros((2, len(at)))
    best: Solution | None = None
    stack = [(p.lower, p.upper, root.objective, root.basis, None)]
    proved, open_bounds = True, []
    while stack:
        if nodes >= o.nodes:
            proved, open_bounds = False, [s[2] for s in stack]
            break
        lower, upper, parent, basis, moved = stack.pop()
        if best is not None and parent >= best.objective - o.gap:
            continue
        nodes += 1
        s = solve(replace(p, lower=lower, upper=upper), o.lp, basis)
        if s.status == "infeasible":
            continue
        if s.status != "optimal":
            proved = False
            continue
        if moved is not None:
            side, k, part = moved
            gain[side, k] += max(0.0, s.objective - parent) / max(part, 1e-9)
            seen[side, k] += 1
        if best is not None and s.objective >= best.objective - o.gap:
            continue
        x = s.x[at]
        off = np.abs(x - np.round(x))
        loose = np.flatnonzero(off > o.integrality)
        if not len(loose):
            best = s
            continue
        rate = np.where(seen > 0, gain / np.maximum(seen, 1), gain.sum() / max(seen.sum(), 1) if seen.any() else 1.0)
        part = x - np.floor(x)
        score = np.maximum(rate[0] * part, 1e-6) * np.maximum(rate[1] * (1 - part), 1e-6)
        k = int(loose[score[loose].argmax()])
        down, up = upper.copy(), lower.copy()
        down[at[k]], up[at[k]] = np.floor(x[k]), np.ceil(x[k])
        sides = [(lower, down, s.objective, s.basis, (0, k, part[k])), (up, upper, s.objective, s.basis, (1, k, 1 - part[k]))]
        stack += sides if part[k] > 0.5 else sides[::-1]
    if best is None:
        return MipSolution(Solution("infeasible" if proved else "limit", 0.0, np.zeros(p.a.shape[1]), np.zeros(rows)), nodes, proved, INF)
    return MipSolution(replace(best, dual=best.dual[:rows]), nodes, proved, min(*open_bounds, best.objective) if open_bounds else best.objective)
