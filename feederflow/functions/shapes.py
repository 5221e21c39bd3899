"""Outlines: fewer points, no crossings, areas, triangles; for use in grouped pandas functions over rings of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAME = 1e-12


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points of a line without which it would be off by more than ``tolerance`` (Douglas and Peucker); its ends stay."""
    points = np.asarray(points, float).reshape(-1, 2)
    if len(points) < 3:
        return points
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    work = [(0, len(points) - 1)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        along, inner = points[b] - points[a], points[a + 1 : b]
        size = float(along @ along)
        share = np.clip((inner - points[a]) @ along / size, 0, 1) if size > np.finfo(float).eps else np.zeros(len(inner))
        off = np.hypot(*(inner - points[a] - share[:, None] * along).T)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            work += [(a, a + 1 + far), (a + 1 + far, b)]
    return points[keep]


def distinct(ring: np.ndarray) -> np.ndarray:
    """A closed ring without points that repeat the one before, and without its first point at the end."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    if len(ring) < 2:
        return ring
    ring = ring[np.concatenate([[True], (np.abs(np.diff(ring, axis=0)) > SAME).any(axis=1)])]
    while len(ring) > 1 and (np.abs(ring[0] - ring[-1]) < SAME).all():
        ring = ring[:-1]
    return ring


def signed_area2(ring: np.ndarray) -> float:
    """Twice the area within a ring, positive where it turns left."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    x, y = ring.T
    return float(x @ np.roll(y, -1) - np.roll(x, -1) @ y)


def _side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    return np.where(v > 1e-14, 1, np.where(v < -1e-14, -1, 0))


def crossings(ring: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of sides that cross within both, each side by its first point."""
    n, after = len(ring), np.roll(ring, -1, axis=0)
    out = []
    for i in range(n - 1):
        others = np.arange(i + 2, n if i else n - 1)
        if len(others):
            a, b, c, d = ring[i], after[i], ring[others], after[others]
            hit = (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)
            out += [(i, int(j)) for j in others[hit]]
    return out


def repair(ring: np.ndarray, most: float = 0.25) -> tuple[np.ndarray, int, int]:
    """``(ring, removed, stubborn)``: small loops that a ring makes over itself cut off, the smallest first.

    A loop of more than ``most`` of the points is left, and all crossings that remain then are counted.
    """
    ring, removed = np.asarray(ring, float).reshape(-1, 2), 0
    while len(ring) >= 4 and (found := crossings(ring)):
        n = len(ring)
        i, j = min(found, key=lambda c: (min(c[1] - c[0], n - c[1] + c[0]), c))
        inside = j - i
        if min(inside, n - inside) > int(n * most):
            return ring, removed, len(found)
        ring = distinct(np.delete(ring, np.s_[i + 1 : j + 1], axis=0) if inside <= n - inside else ring[i + 1 : j + 1])
        removed += 1
    return ring, removed, 0


def triangulate(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """A simple ring as triangles of its points' numbers, cut off an ear at a time: a corner that turns like the ring and
    holds no other point. A ring that has no ear left gives what was cut so far."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    left = list(range(len(ring)))
    turn = 1 if signed_area2(ring) > 0 else -1
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if turn * _side(ring[a], ring[b], ring[c]) <= 0:
                continue
            rest = ring[[v for v in left if v not in (a, b, c)]]
            sides = np.stack([turn * _side(ring[p], ring[q], rest) for p, q in ((a, b), (b, c), (c, a))])
            if not (sides >= 0).all(axis=0).any():
                out.append((a, b, c))
                left.pop(k)
                break
        else:
            return out
    return [*out, tuple(left)] if len(left) == 3 else out


def spread(xy: np.ndarray, edges: np.ndarray, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """Places for the nodes of a network by forces: all push each other away, neighbours pull, and each step is shorter
    than the one before (Fruchterman and Reingold). Nodes without a place start on a ring."""
    n = len(xy)
    if n < 2:
        return np.nan_to_num(np.asarray(xy, float))
    turn = 2 * np.pi * np.arange(n) / n
    at = np.where(np.isnan(xy), np.stack([np.cos(turn), np.sin(turn)], axis=1), xy).astype(float)
    at += 1e-6 * np.random.default_rng(seed).standard_normal(at.shape)
    side = max(np.ptp(at, axis=0).max(), 1e-9)
    best = side / np.sqrt(n)
    for k in range(rounds):
        apart = at[:, None] - at[None]
        far = np.maximum(np.hypot(apart[..., 0], apart[..., 1]), 1e-9)
        push = (apart * (best**2 / far**2)[..., None]).sum(axis=1)
        along = at[edges[:, 0]] - at[edges[:, 1]]
        pull = along * (np.hypot(along[:, 0], along[:, 1]) / best)[:, None]
        np.add.at(push, edges[:, 0], -pull)
        np.add.at(push, edges[:, 1], pull)
        size = np.maximum(np.hypot(push[:, 0], push[:, 1]), 1e-9)
        step = 0.1 * side * (1 - k / rounds)
        at += push / size[:, None] * np.minimum(size, step)[:, None]
    return at


def simplified(points: DataFrame, tolerance: float, key: str = "shape") -> DataFrame:
    """``(key, n, x, y)``: each ring of ``points(key, n, x, y)`` without repeated points, crossings and needless points."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ring, _, _ = repair(distinct(pdf.sort_values("n")[["x", "y"]].to_numpy(float)))
        ring = simplify(ring, tolerance)
        return pd.DataFrame({key: pdf[key].iloc[0], "n": np.arange(len(ring)), "x": ring[:, 0], "y": ring[:, 1]})

    return points.select(key, "n", "x", "y").groupBy(key).applyInPandas(one, f"{key} {dict(points.dtypes)[key]}, n int, x double, y double")


def areas(points: DataFrame, key: str = "shape") -> DataFrame:
    """``(key, area2)``: twice the signed area of each ring, without leaving the engine."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("n", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rolled = F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1))
    terms = F.zip_with("r", rolled, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return points.groupBy(key).agg(ring.alias("r")).select(key, F.aggregate(terms, F.lit(0.0), lambda s, t: s + t).alias("area2"))
