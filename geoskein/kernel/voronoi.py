"""Boundary samples, their Delaunay triangles and the Voronoi diagram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def regular_samples(ring: np.ndarray, interval: float) -> tuple[np.ndarray, np.ndarray]:
    """(points, segment of each) at 0, interval, 2 interval, ... below the length of a closed ring; all its axes."""
    step = np.diff(ring, axis=0)
    length = np.sqrt((step * step).sum(axis=1))
    cum = np.cumsum(length)
    d = np.arange(max(0, int(np.ceil(cum[-1] / interval)))) * interval
    d = d[d < cum[-1]]
    seg = np.searchsorted(cum, d, side="left")
    unit = np.divide(step, length[:, None], out=np.zeros_like(step), where=length[:, None] > 0)
    return ring[1:][seg] + unit[seg] * (d - cum[seg])[:, None], seg


class Walk:
    """A closed ring, measured once."""

    def __init__(self, ring: np.ndarray):
        self.ring, self.step = ring, np.diff(ring, axis=0)
        self.length = np.sqrt((self.step * self.step).sum(axis=1))
        self.cum = np.cumsum(self.length)

    def along(self, distance: float) -> np.ndarray:
        """The point at a distance from the first vertex; below 0 from the end."""
        step, length, cum = self.step, self.length, self.cum
        distance = distance % cum[-1]
        k = min(int(np.searchsorted(cum, distance, side="left")), len(cum) - 1)
        return self.ring[k + 1] + (step[k] / length[k] if length[k] else 0 * step[k]) * (distance - cum[k])


def proxy_ring(points: np.ndarray, seg: np.ndarray) -> np.ndarray | None:
    """The first and last sample of each boundary segment, closed; None for a ring of fewer than three samples."""
    if len(points) < 3:
        return None
    edge = np.flatnonzero(np.diff(seg)) + 1
    keep = np.unique(np.concatenate([[0], edge - 1, edge, [len(points) - 1]]))
    return np.vstack([points[keep], points[keep[:1]]])


def localizers(points: np.ndarray) -> np.ndarray:
    """Four points west, east, south and north, beyond each side by 1.15 times the larger span."""
    low, high = points.min(axis=0), points.max(axis=0)
    mid, reach = (low + high) / 2, 1.15 * (high - low).max()
    return np.array([[low[0] - reach, mid[1]], [high[0] + reach, mid[1]], [mid[0], low[1] - reach], [mid[0], high[1] + reach]])


#: Points between two looks for final triangles.
SWEPT = 16


def circumcircles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centers, squared radii) of triangles; flat ones have infinite radii."""
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    b2, c2 = (b * b).sum(axis=1), (c * c).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.stack([(c[:, 1] * b2 - b[:, 1] * c2) / d, (b[:, 0] * c2 - c[:, 0] * b2) / d], axis=1)
    r = (u * u).sum(axis=1)
    return a + u, np.where(np.isfinite(r), r, np.inf)


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (sorted indices, sorted rows) by inserting one point after another into a covering triangle.

    A shift far below the resolution of the data, the same at every run, breaks ties of collinear and cocircular
    points; coordinates handed on are the given ones.
    """
    n = len(points)
    span = max(float((points.max(axis=0) - points.min(axis=0)).max()), 1e-300)
    shift = np.random.default_rng(n).random((n, 2)) - 0.5
    p = (points - points.mean(axis=0)) / span + 1e-9 * shift
    p = np.vstack([p, [[-300.0, -200.0], [300.0, -200.0], [0.0, 400.0]]])
    # points come from left to right: a triangle whose circle lies left of the next point is final
    tri = np.array([[n, n + 1, n + 2]])
    center, radius = circumcircles(p, tri)
    final = []
    for turn, k in enumerate(np.lexsort((p[:n, 1], p[:n, 0])).tolist()):
        if turn % SWEPT == 0:
            done = center[:, 0] + np.sqrt(radius) < p[k, 0] - 1e-6
            final.append(tri[done])
            tri, center, radius = tri[~done], center[~done], radius[~done]
        d = center - p[k]
        bad = (d * d).sum(axis=1) < radius
        edges: dict[tuple[int, int], int] = {}
        for a, b, c in tri[bad].tolist():
            for e in ((a, b), (b, c), (a, c)):
                e = e if e[0] < e[1] else (e[1], e[0])
                edges[e] = edges.get(e, 0) + 1
        new = np.array([(a, b, k) for (a, b), times in edges.items() if times == 1])
        more, r = circumcircles(p, new)
        tri, center, radius = np.concatenate([tri[~bad], new]), np.concatenate([center[~bad], more]), np.concatenate([radius[~bad], r])
    live = np.concatenate([*final, tri])
    live = np.sort(live[(live < n).all(axis=1)], axis=1)
    return live[np.lexsort(live.T[::-1])]


@dataclass
class Voronoi:
    points: np.ndarray
    vertices: np.ndarray
    #: sample, sample, vertex, vertex; -1 is infinity
    ridges: np.ndarray
    triangles: np.ndarray
    #: the vertex of each triangle
    vertex_of: np.ndarray


#: What may be taken off all points before the diagram is made, and is put back after; and what happens to equal points.
TRANSLATIONS = {"NONE": lambda p: np.zeros(2), "FIRST": lambda p: p[0], "MEAN": lambda p: p.mean(axis=0), "MEDIAN": lambda p: np.median(p, axis=0), "MIN": lambda p: p.min(axis=0)}
MERGES = ("IGNORE", "ERROR")


def used(points: np.ndarray, merge: str = "IGNORE") -> np.ndarray | None:
    """Indices of the first of each group of equal points, None where no two are equal; with ERROR equal points raise."""
    if merge not in MERGES:
        raise ValueError(f"{merge!r} is none of {MERGES}")
    first = np.sort(np.unique(points, axis=0, return_index=True)[1])
    if len(first) == len(points):
        return None
    if merge == "ERROR":
        raise ValueError("equal points")
    return first


def voronoi(points: np.ndarray, tolerance: float = 1e-7, translate: str = "MEAN", merge: str = "IGNORE") -> Voronoi:
    """The diagram of the points that used() leaves; ridges and triangles carry indices of the given ones. Circumcentres closer
    than tolerance times the span are one vertex."""
    if translate not in TRANSLATIONS:
        raise ValueError(f"{translate!r} is none of {tuple(TRANSLATIONS)}")
    kept = used(points, merge)
    if kept is not None:
        d = voronoi(points[kept], tolerance, translate)
        ridges = d.ridges.copy()
        ridges[:, :2] = kept[ridges[:, :2]]
        return Voronoi(points, d.vertices, ridges, kept[d.triangles], d.vertex_of)
    mean = TRANSLATIONS[translate](points)
    p = points - mean
    tri = delaunay(p)
    center, radius = circumcircles(p, tri)
    span = float((p.max(axis=0) - p.min(axis=0)).max())
    flat = ~np.isfinite(radius)
    center[flat] = p[tri[flat]].mean(axis=1)
    cell = np.round(center / (tolerance * span)) if span else center
    _, first, inverse = np.unique(cell, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    vertex_of = place[inverse.reshape(-1)]
    sides = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [0, 2]]])
    owner = np.tile(vertex_of, 3)
    by = np.lexsort((owner, sides[:, 1], sides[:, 0]))
    sides, owner = sides[by], owner[by]
    ridges = []
    k = 0
    while k < len(sides):
        if k + 1 < len(sides) and (sides[k] == sides[k + 1]).all():
            if owner[k] != owner[k + 1]:
                ridges.append((*sides[k], owner[k], owner[k + 1]))
            k += 2
        else:
            ridges.append((*sides[k], -1, owner[k]))
            k += 1
    return Voronoi(points, center[first[order]] + mean, np.array(ridges, np.int64).reshape(-1, 4), tri, vertex_of)


def peripheral(ridges: np.ndarray, ring_of: np.ndarray) -> np.ndarray:
    """Whether a ridge parts neighbouring samples of one ring. ring_of: ring of each sample, localizers -1 at the end.

    Neighbours differ by 1, or are the first and last of a ring.
    """
    a, b = np.minimum(ridges[:, 0], ridges[:, 1]), np.maximum(ridges[:, 0], ridges[:, 1])
    n = len(ring_of)
    first, last = np.full(n, -1), np.full(n, -1)
    for r in np.unique(ring_of[ring_of >= 0]):
        own = np.flatnonzero(ring_of == r)
        first[own[-1]], last[own[0]] = own[0], own[-1]
    same = ring_of[a] == ring_of[b]
    return ((b - a == 1) & (same | (ring_of[b] < 0))) | (same & (ring_of[a] >= 0) & (last[a] == b))


#: Pairs of a point and an edge at its height that are tested at a time.
PAIRS = 1 << 20


def inside_rings(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Whether points lie in the first ring and in no other, by crossing parity. An edge meets the points of its heights only."""
    out = np.zeros(len(points), bool)
    order = np.argsort(points[:, 1], kind="stable")
    px, py = points[order, 0], points[order, 1]
    for k, ring in enumerate(rings):
        x0, y0, x1, y1 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
        low, high = np.searchsorted(py, np.minimum(y0, y1)), np.searchsorted(py, np.maximum(y0, y1))
        crossed = np.zeros(len(points), np.int64)
        before = np.concatenate([[0], np.cumsum(high - low)])
        edge = 0
        while edge < len(x0):
            last = max(edge + 1, int(np.searchsorted(before, before[edge] + PAIRS, "right")) - 1)
            n = high[edge:last] - low[edge:last]
            e = np.repeat(np.arange(edge, last), n)
            p = np.arange(len(e)) - np.repeat(before[edge:last] - before[edge], n) + low[e]
            hit = (x1[e] - x0[e]) / (y1[e] - y0[e]) * (py[p] - y0[e]) + x0[e] > px[p]
            crossed += np.bincount(p[hit], minlength=len(points)) if hit.any() else 0
            edge = last
        odd = np.empty(len(points), bool)
        odd[order] = crossed % 2 == 1
        out = odd if k == 0 else out & ~odd
    return out
