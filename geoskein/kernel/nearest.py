"""Nearest points by a balanced tree of boxes, and farthest pairs by convex hulls. numpy only."""

from __future__ import annotations

import numpy as np

#: Points whose boxes are compared together, and points of a hull whose distances are.
CHUNK, HULL_CHUNK = 4096, 512


def nearest(px: np.ndarray, py: np.ndarray, ox: np.ndarray, oy: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, squared distance) of the nearest other of each point, ties to the smaller id. There must be others.

    Others are halved at the median of the wider side of their box, level by level; node j's halves are 2j and 2j + 1.
    Points go down the levels with all nodes that may hold their nearest: those no farther than the farthest corner of
    some other node.
    """
    # of others at one place the smallest id is enough
    order = np.lexsort((ids, oy, ox))
    ox, oy, ids = ox[order], oy[order], ids[order]
    new = np.r_[True, (ox[1:] != ox[:-1]) | (oy[1:] != oy[:-1])]
    ox, oy, ids = ox[new], oy[new], ids[new]
    n, perm, levels = len(ox), np.arange(len(ox)), 0
    while n >> (levels + 2):
        levels += 1
    boxes = []
    for level in range(levels + 1):
        starts = (np.arange((1 << level) + 1) * n) >> level
        x, y = ox[perm], oy[perm]
        box = [f.reduceat(v, starts[:-1]) for v in (x, y) for f in (np.minimum, np.maximum)]
        boxes.append(box)
        if level < levels:
            wide = box[1] - box[0] >= box[3] - box[2]
            node = np.repeat(np.arange(1 << level), np.diff(starts))
            perm = perm[np.lexsort((np.where(wide[node], x, y), node))]
    ox, oy, ids = ox[perm], oy[perm], ids[perm]
    best_id, best = np.empty(len(px), ids.dtype), np.empty(len(px))
    for at in range(0, len(px), CHUNK):
        qx, qy = px[at : at + CHUNK], py[at : at + CHUNK]
        point, node = np.arange(len(qx)), np.zeros(len(qx), np.int64)
        for level, (x0, x1, y0, y1) in enumerate(boxes):
            if level:
                point, node = np.repeat(point, 2), (2 * node[:, None] + [0, 1]).ravel()
            x, y = qx[point], qy[point]
            dx = np.maximum(0, np.maximum(x0[node] - x, x - x1[node]))
            dy = np.maximum(0, np.maximum(y0[node] - y, y - y1[node]))
            fx, fy = np.maximum(abs(x - x0[node]), abs(x - x1[node])), np.maximum(abs(y - y0[node]), abs(y - y1[node]))
            most = np.full(len(qx), np.inf)
            np.minimum.at(most, point, fx * fx + fy * fy)
            stays = dx * dx + dy * dy <= most[point] * (1 + 1e-9)
            point, node = point[stays], node[stays]
        starts = (np.arange((1 << levels) + 1) * n) >> levels
        sizes = starts[node + 1] - starts[node]
        own = np.repeat(starts[node] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        point = np.repeat(point, sizes)
        d = (qx[point] - ox[own]) * (qx[point] - ox[own]) + (qy[point] - oy[own]) * (qy[point] - oy[own])
        order = np.lexsort((ids[own], d, point))
        first = order[np.r_[True, point[order][1:] != point[order][:-1]]]
        best_id[at : at + CHUNK], best[at : at + CHUNK] = ids[own[first]], d[first]
    return best_id, best


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull; of points at one place the first."""
    order = np.lexsort((y, x))
    order = order[np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]] if len(order) else order
    if len(order) < 3:
        return order
    xs, ys = x.tolist(), y.tolist()

    def half(places: list[int]) -> list[int]:
        out: list[int] = []
        for k in places:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (xs[b] - xs[a]) * (ys[k] - ys[a]) - (ys[b] - ys[a]) * (xs[k] - xs[a]) > 0:
                    break
                out.pop()
            out.append(k)
        return out

    places = order.tolist()
    return np.array(sorted({*half(places), *half(places[::-1])}))


def farthest(x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> tuple[int, int, float]:
    """(id, id, squared distance) of the two most distant points, ties to the smaller ids. There must be two."""
    order = np.argsort(ids, kind="stable")
    x, y, ids = x[order], y[order], ids[order]
    corners = hull(x, y)
    if len(corners) < 2:
        return int(ids[0]), int(ids[1]), 0.0
    x, y, ids = x[corners], y[corners], ids[corners]
    best = (1.0, 0, 0)
    for at in range(0, len(x), HULL_CHUNK):
        part = slice(at, at + HULL_CHUNK)
        d = (x[part, None] - x) * (x[part, None] - x) + (y[part, None] - y) * (y[part, None] - y)
        for a, b in np.argwhere(d == d.max()).tolist():
            own = sorted((int(ids[at + a]), int(ids[b])))
            best = min(best, (-float(d[a, b]), *own))
    return best[1], best[2], -best[0]
