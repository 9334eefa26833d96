"""From a Voronoi diagram to trunks, branches, bridges and loops.

Ties are broken by vertex number throughout, so the same polygon always gives the same lines.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from geoskein.kernel import voronoi as V


@dataclass
class Edge:
    chain: list[int]
    length: float

    @property
    def ends(self) -> tuple[int, int]:
        return self.chain[0], self.chain[-1]


@dataclass
class Line:
    kind: str
    chain: list[int]
    length: float
    stem: int | None = None
    stub: int | None = None
    tails: dict[int, np.ndarray] = field(default_factory=dict)


@dataclass
class Options:
    interval: float
    min_normalized_length: float = 0.0
    mode: str = "PREFER_BRIDGE"
    trunk_mode: str = "DEFAULT"
    tails: bool = True
    loops: bool = True
    cut: bool = False
    naive: bool = False
    verify: bool = False
    graph_only: bool = False
    max_branch_count: int | None = None
    max_trunk_count: int = 1
    shortest_branch: float = 0.0
    shortest_bridge: float = 0.0
    shortest_loop: float = 0.0


MODES = ("PREFER_BRIDGE", "MAX_BRIDGE", "MAX_BRIDGE_MAX_BRANCH", "PREFER_BRANCH", "MAX_BRANCH", "MAX_BRANCH_MAX_BRIDGE")
#: Fixed values; # stands for a number. 3D, HIGH and RELIEF need heights.
TRUNK_MODES = (
    "DEFAULT", "NONE", "EUCLIDEAN", "EUCLIDEAN3D", "MIN_EUCLIDEAN_#", "MIN_EUCLIDEAN3D_#", "NEAR_#_#", "NEAR_#_#_AND_#_#", "HIGH_LOW", "MIN_RELIEF_#", "MIN_RELIEF_#%", "MIN_MEAN_WIDTH_#",
)
_SINGLE = ("EUCLIDEAN", "EUCLIDEAN3D", "NEAR_#_#", "NEAR_#_#_AND_#_#", "HIGH_LOW")
_NUMBER = r"([-+]?\d+(?:\.\d*)?)"


def trunk_form(mode: str) -> tuple[str, list[float]]:
    """The one of TRUNK_MODES that a mode spells, in any case, and its numbers."""
    for form in TRUNK_MODES:
        if found := re.fullmatch(re.escape(form).replace(r"\#", _NUMBER), mode, re.I):
            return form, [float(x) for x in found.groups()]
    raise ValueError(f"unknown trunk mode {mode!r}")


def isolation_flags(text: str) -> dict[str, bool]:
    """Options cut, naive and verify from words joined by _, as CUT_NAIVE."""
    words = [w for w in text.upper().split("_") if w]
    if unknown := set(words) - {"CUT", "NAIVE", "VERIFY"}:
        raise ValueError(f"unknown isolation options {sorted(unknown)}")
    return {w.lower(): True for w in words}


def check(o: Options) -> None:
    """Raise for options that no polygon can be made with."""
    if o.mode not in MODES:
        raise ValueError(f"unknown mode {o.mode!r}")
    form, _ = trunk_form(o.trunk_mode)
    if form in _SINGLE and o.max_trunk_count > 1:
        raise ValueError(f"trunk mode {form} gives one trunk")
    if not o.interval > 0:
        raise ValueError("the interval must be above 0")


def check_rings(rings: list[np.ndarray]) -> None:
    """Raise for what is no polygon: no rings, rings of several dimensions, open or short ones, coordinates not finite."""
    if not rings:
        raise ValueError("a polygon needs a ring")
    for r in rings:
        if r.ndim != 2 or r.shape[1] not in (2, 3) or r.shape[1] != rings[0].shape[1]:
            raise ValueError("rings must have one dimension, 2 or 3")
        if len(r) < 4:
            raise ValueError("a ring needs four vertices")
        if not np.isfinite(r).all():
            raise ValueError("a coordinate is not finite")
        if (r[0, :2] != r[-1, :2]).any():
            raise ValueError("a ring must end where it begins")
        if not (np.diff(r[:, :2], axis=0) != 0).any():
            raise ValueError("a ring has no length")


class NotIsolated(ValueError):
    """The skeleton couldn't be told from its complement."""


class Graph:
    """Adjacency of the non-peripheral ridges with coordinates; hyperhubs are cracked into rings of duplicates."""

    def __init__(self, xy: np.ndarray, pairs: np.ndarray):
        self.xy = [tuple(p) for p in xy]
        self.near: dict[int, set[int]] = defaultdict(set)
        self.origin = list(range(len(xy)))
        for a, b in pairs.tolist():
            self.near[a].add(b)
            self.near[b].add(a)
        for v in sorted(self.near):
            if len(self.near[v]) > 3:
                self._crack(v)

    def _crack(self, v: int) -> None:
        x, y = self.xy[v]
        around = sorted(self.near.pop(v), key=lambda u: (np.arctan2(self.xy[u][1] - y, self.xy[u][0] - x), u))
        made = []
        for u in around:
            k = len(self.xy)
            self.xy.append((x, y))
            self.origin.append(v)
            self.near[u].discard(v)
            self.near[u].add(k)
            self.near[k].add(u)
            made.append(k)
        for a, b in zip(made, made[1:] + made[:1]):
            self.near[a].add(b)
            self.near[b].add(a)

    def length(self, chain: list[int]) -> float:
        p = np.array([self.xy[k] for k in chain])
        return float(np.sqrt((np.diff(p, axis=0) ** 2).sum(axis=1)).sum())

    def remove(self, nodes: set[int]) -> None:
        for v in nodes:
            for u in self.near.pop(v, ()):
                self.near[u].discard(v)
        for v in [v for v, n in self.near.items() if not n]:
            del self.near[v]

    def contracted(self) -> tuple[list[Edge], list[Edge]]:
        """(edges, loops): chains through nodes of degree 2, each once. A component that is one ring is a loop at its least
        node. Of parallel edges all but the first are split at their middle node."""
        done: set[tuple[int, int]] = set()
        chains = []

        def walk(a: int, b: int) -> list[int]:
            chain = [a, b]
            while len(self.near[chain[-1]]) == 2 and chain[-1] != a:
                chain.append(next(u for u in sorted(self.near[chain[-1]]) if u != chain[-2]))
            return chain

        ends = [v for v in sorted(self.near) if len(self.near[v]) != 2]
        seen: set[int] = set()
        for a in ends:
            for b in sorted(self.near[a]):
                if (a, b) not in done:
                    chain = walk(a, b)
                    done |= {(a, b), (chain[-1], chain[-2])}
                    seen.update(chain)
                    chains.append(chain)
        for a in sorted(self.near):
            if a not in seen and len(self.near[a]) == 2:
                chain = walk(a, min(self.near[a]))
                seen.update(chain)
                chains.append(chain)
        edges, loops, pairs = [], [], set()
        for chain in chains:
            e = Edge(chain, self.length(chain))
            key = frozenset(e.ends)
            if len(key) == 1:
                loops.append(e)
            elif key in pairs and len(chain) > 2:
                m = len(chain) // 2
                edges += [Edge(part, self.length(part)) for part in (chain[: m + 1], chain[m:])]
            else:
                pairs.add(key)
                edges.append(e)
        return edges, loops


def _components(edges: list[Edge], loops: list[Edge]) -> dict[int, int]:
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for e in [*edges, *loops]:
        a, b = map(root, e.ends)
        up[max(a, b)] = min(a, b)
    return {v: root(v) for v in up}


def isolate(g: Graph, test: list[np.ndarray], cut: bool = False, naive: bool = False, verify: bool = False) -> tuple[list[Edge], list[Edge], list[int]]:
    """(edges, loops, cut nodes) of the skeleton: of all components that with the most hubs inside the test polygon.

    The first wins of several. A component without hubs counts by its other end nodes. With `naive` components
    are tried by size, and the first whose first hub is inside wins without a look at the others; with `verify` they
    are looked at, and the vote decides after all where one is outside. Hubs outside are an error, unless `cut`, which
    deletes them and tries again, twice at most.
    """
    removed: list[int] = []
    for turn in range(3 if cut else 1):
        edges, loops = g.contracted()
        part = _components(edges, loops)
        degree: dict[int, int] = defaultdict(int)
        for e in edges:
            for v in e.ends:
                degree[v] += 1
        members: dict[int, list[int]] = defaultdict(list)
        for v in sorted(part):
            members[part[v]].append(v)
        votes = {}
        for label, nodes in members.items():
            hubs = [v for v in nodes if degree[v] >= 3] or nodes
            votes[label] = (hubs, V.inside_rings(np.array([g.xy[v] for v in hubs]), test))
        if not votes:
            raise NotIsolated("no ridges within the polygon")
        voted = max(sorted(votes), key=lambda k: (votes[k][1].sum(), -k))
        by_size = sorted(votes, key=lambda k: (-len(members[k]), k)) if naive else []
        winner = next((k for k in by_size if votes[k][1][0]), voted)
        trusted = naive and not verify and bool(votes[winner][1][0])
        if not trusted and not votes[winner][1].all():
            winner = voted
        hubs, inside = votes[winner]
        if trusted or inside.all():
            keep = set(members[winner])
            return [e for e in edges if e.ends[0] in keep], [e for e in loops if e.ends[0] in keep], removed
        outside = [v for v, ok in zip(hubs, inside) if not ok]
        if turn + 1 < (3 if cut else 1):
            removed += outside
            g.remove(set(outside))
    raise NotIsolated("the skeleton could not be isolated")


class Partition:
    """Lines moved out of the graph, the longest of shortest paths first.

    Edges not yet in a line are free; they fall into regions that share no node, and no path leaves its region. What is
    found in a region is kept until a line is moved out of it, or one that meets it is deleted; until then no look comes
    back to it.
    """

    def __init__(self, g: Graph, edges: list[Edge], loops: list[Edge]):
        self.g, self.edges, self.loops = g, edges, loops
        self.free: dict[int, dict[int, int]] = defaultdict(dict)
        self.degree: dict[int, int] = defaultdict(int)
        for k, e in enumerate(edges):
            for a, b in (e.ends, e.ends[::-1]):
                self.free[a][k] = b
                self.degree[a] += 1
        self.lines: list[Line] = []
        self.part: dict[int, int] = defaultdict(int)
        self.tail_of: Callable[[int], np.ndarray | None] | None = None
        self.deleted = False
        self.regions: dict[int, list[int]] = {}
        self.known: dict[tuple[int, str], tuple | None] = {}
        #: regions that a look has still to come to, by look
        self.unseen: dict[tuple, set[int]] = {}
        self.region_of: dict[int, int] = {}
        self.queues: dict[str, list[tuple[float, int, int, int]]] = defaultdict(list)
        self.untailed: list[Line] = []
        self.count = 0
        self._split(sorted(self.degree))

    def _split(self, nodes: list[int]) -> None:
        """Regions of what is free among the nodes."""
        seen: set[int] = set()
        for v in nodes:
            if v in seen or not self.free[v]:
                continue
            own, queue = [], [v]
            seen.add(v)
            while queue:
                u = queue.pop()
                own.append(u)
                for w in self.free[u].values():
                    if w not in seen:
                        seen.add(w)
                        queue.append(w)
            self.regions[self.count] = sorted(own)
            self.region_of.update(dict.fromkeys(own, self.count))
            for rids in self.unseen.values():
                rids.add(self.count)
            self.count += 1

    def _look(self, *look) -> list[int]:
        """The regions that a look hasn't come to as they are, in order; from now on it has."""
        rids = sorted(self.unseen.get(look, self.regions))
        self.unseen[look] = set()
        return [rid for rid in rids if rid in self.regions]

    def _divide(self, rid: int) -> None:
        for kind in ("branch", "bridge"):
            self.known.pop((rid, kind), None)
        self._split(self.regions.pop(rid))

    def stubs(self) -> list[int]:
        return sorted(v for v, d in self.degree.items() if d == 1)

    def tree(self, start: int) -> tuple[dict[int, float], dict[int, tuple[int, int]]]:
        """Least lengths from a node over free edges, and (edge, node) before each node."""
        best, via, heap = {start: 0.0}, {}, [(0.0, start)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > best[v]:
                continue
            for k, u in sorted(self.free[v].items()):
                new = d + self.edges[k].length
                if u not in best or new < best[u]:
                    best[u], via[u] = new, (k, v)
                    heapq.heappush(heap, (new, u))
        return best, via

    def path(self, via: dict[int, tuple[int, int]], end: int) -> list[int]:
        out = []
        while end in via:
            k, end = via[end]
            out.append(k)
        return out[::-1]

    def _pools(self, rid: int, kind: str) -> tuple[list[int], list[int]]:
        """Where lines of a kind may begin and end in a region: nodes in use, and stubs that aren't or others in use."""
        used = [v for v in self.regions[rid] if self.part[v]]
        return used, used if kind == "bridge" else [v for v in self.regions[rid] if self.degree[v] == 1 and not self.part[v]]

    def candidates(self, rid: int, kind: str) -> list[tuple[float, int, int, list[int]]]:
        """(length, start, end, edges) of the shortest path between each start and end of a region, the longest first."""
        starts, ends = self._pools(rid, kind)
        turned = len(ends) < len(starts)
        out = []
        for a in ends if turned else starts:
            best, via = self.tree(a)
            for b in starts if turned else ends:
                if b in via and (kind == "branch" or a < b):
                    ks = self.path(via, b)
                    out.append((best[b], b, a, ks[::-1]) if turned else (best[b], a, b, ks))
        return sorted(out, key=lambda c: (-c[0], c[1], c[2]))

    def best(self, rid: int, kind: str) -> tuple[float, int, int, list[int]] | None:
        """The first of candidates()."""
        if (rid, kind) not in self.known:
            starts, ends = self._pools(rid, kind)
            turned = len(ends) < len(starts)
            top = None
            for a in ends if turned else starts:
                best, via = self.tree(a)
                for b in starts if turned else ends:
                    if b in via and (kind == "branch" or a < b):
                        key = (-best[b], b, a) if turned else (-best[b], a, b)
                        if top is None or key < top[0]:
                            top = key, via, b
            if top is not None:
                (cost, start, end), via, b = top
                ks = self.path(via, b)
                top = -cost, start, end, ks if b == end else ks[::-1]
            self.known[rid, kind] = top
        return self.known[rid, kind]

    def one(self, kind: str, shortest: float = 0.0) -> bool:
        """Move out the longest line of a kind, whole."""
        queue = self.queues[kind]
        for rid in self._look("one", kind):
            if (c := self.best(rid, kind)) is not None:
                heapq.heappush(queue, (-c[0], c[1], c[2], rid))
        while queue:
            cost, start, end, rid = queue[0]
            c = self.known.get((rid, kind))
            if c is not None and (-c[0], c[1], c[2]) == (cost, start, end):
                break
            heapq.heappop(queue)
        if not queue or -cost < shortest:
            return False
        self.register(kind, c[3], start)
        self._divide(rid)
        return True

    def many(self, kind: str, shortest: float = 0.0) -> int:
        """Move out all lines of a kind that one look finds, the longest first; of a path that meets an earlier one the free
        parts at its ends stay. How many were moved out."""
        added = 0
        for rid in self._look("many", kind, shortest):
            before = added
            for cost, start, end, ks in self.candidates(rid, kind):
                if cost < shortest:
                    break
                nodes = self._nodes(ks, start)
                open_ = [k in self.free[nodes[n]] for n, k in enumerate(ks)]
                if all(open_):
                    self.register(kind, ks, start)
                    added += 1
                    continue
                head = open_.index(False)
                back = len(ks) - open_[::-1].index(False)
                for own, at in ((ks[back:], nodes[back]), (ks[:head], start)):
                    if own and sum(self.edges[k].length for k in own) >= shortest:
                        self.register(kind, own, at)
                        added += 1
            if added > before:
                self._divide(rid)
        return added

    def sweep(self, shortest_branch: float = 0.0, shortest_bridge: float = 0.0) -> None:
        """Move out regions of one edge, as bridges between nodes in use, else as branches; those of a kind left out go, and
        so do those that no line reaches any more."""
        for rid in self._look("sweep", shortest_branch, shortest_bridge):
            nodes = self.regions[rid]
            if len(nodes) != 2 or any(len(self.free[v]) != 1 for v in nodes):
                continue
            (k,) = self.free[nodes[0]]
            used = [v for v in self.edges[k].ends if self.part[v]]
            if not used and not self.deleted:
                continue
            least = shortest_bridge if len(used) == 2 else shortest_branch
            if not used or least < 0:
                for v in nodes:
                    del self.free[v][k]
            elif self.edges[k].length >= least:
                self.register("bridge" if len(used) == 2 else "branch", [k], used[0])
            else:
                continue
            self._divide(rid)

    def _nodes(self, ks: list[int], start: int) -> list[int]:
        nodes = [start]
        for k in ks:
            a, b = self.edges[k].ends
            nodes.append(b if a == nodes[-1] else a)
        return nodes

    def merged(self, ks: list[int], start: int) -> list[int]:
        chain = [start]
        for k in ks:
            c = self.edges[k].chain
            chain += (c if c[0] == chain[-1] else c[::-1])[1:]
        return chain

    def register(self, kind: str, ks: list[int], start: int) -> Line:
        """A line of free edges. A branch between two nodes in use is a bridge, one with none in use a trunk; one that
        ends at its stem is turned."""
        nodes = self._nodes(ks, start)
        if kind == "branch":
            used = [bool(self.part[v]) for v in (nodes[0], nodes[-1])]
            kind = "bridge" if all(used) else "branch" if any(used) else "trunk"
            if used == [False, True]:
                ks, nodes = ks[::-1], nodes[::-1]
        for k in ks:
            for v in self.edges[k].ends:
                self.free[v].pop(k, None)
        for v in nodes[1:-1]:
            self.part[v] += 2
        for v in (nodes[0], nodes[-1]):
            self.part[v] += 1
        line = Line(kind, self.merged(ks, nodes[0]), sum(self.edges[k].length for k in ks))
        if kind == "branch":
            line.stem, line.stub = nodes[0], nodes[-1]
        self.lines.append(line)
        self.untailed.append(line)
        return line

    def trunk(self, form: str = "DEFAULT", numbers: list[float] = (), z: dict[int, float] | None = None, reach: float = 0.0) -> bool:
        """The longest of the shortest paths between stubs not in use (or the pair that the mode asks for). z: heights of
        nodes; reach: the difference of the polygon's heights."""
        ends = [v for v in self.stubs() if not self.part[v]]
        if len(ends) < 2:
            ends = sorted(v for v, d in self.degree.items() if d != 2 and not self.part[v]) or sorted(self.degree)
        if len(ends) < 2:
            return False
        p = {v: np.array([*self.g.xy[v], z[v]] if "3D" in form else self.g.xy[v]) for v in ends}
        apart = lambda a, b: float(((p[a] - p[b]) ** 2).sum())
        start, pairs = ends, None
        if form in _SINGLE:
            if form.startswith("NEAR"):
                to = [np.array(numbers[k : k + 2]) for k in range(0, len(numbers), 2)]
                pair = [min(ends, key=lambda v: (float(((p[v] - t) ** 2).sum()), v)) for t in to]
            elif form == "HIGH_LOW":
                pair = [max(ends, key=lambda v: (z[v], -v)), min(ends, key=lambda v: (z[v], v))]
            else:
                pair = list(max(((a, b) for k, a in enumerate(ends) for b in ends[k + 1 :]), key=lambda ab: (apart(*ab), -ab[0], -ab[1])))
            start, pairs = pair[:1], set(pair[1:]) or None
        if form == "DEFAULT" and not self.lines and len(self.edges) == len(self.degree) - 1 and len(self.regions) == 1:
            # without rings, what is farthest from any end is an end of the longest path
            best, _ = self.tree(ends[0])
            start = [max(ends, key=lambda v: (best[v], -v))]
        found, trees = [], {}
        if form == "DEFAULT" and start is ends:
            found, trees, start = *self._farthest(ends), []
        for a in start:
            best, trees[a] = self.tree(a)
            found += [(best[b], a, b) for b in ends if b in trees[a] and (b > a or start is not ends) and (pairs is None or b in pairs)]
        for _, a, b in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            if form.startswith("MIN_EUCLIDEAN") and apart(a, b) < numbers[0] ** 2:
                continue
            if form.startswith("MIN_RELIEF") and abs(z[a] - z[b]) < abs(numbers[0]) * (reach / 100 if form.endswith("%") else 1):
                continue
            ks = self.path(trees[a], b)
            if form == "MIN_MEAN_WIDTH_#" and self.mean_width(self.merged(ks, a)) < numbers[0]:
                continue
            self.register("trunk", ks, a)
            self._divide(next(rid for rid, nodes in self.regions.items() if a in nodes))
            return True
        return False

    def _farthest(self, ends: list[int]) -> tuple[list[tuple[float, int, int]], dict[int, dict]]:
        """(length, a, b) of the longest of the shortest paths between ends a < b, of each region, all that are equal but for
        rounding; and what trees from each a give as second.

        From the middle of a long path two ends are at most the sum of their distances apart. So ends are looked from in order of
        falling distance, down to half the longest path found: few of them, unless all are as far.
        """
        found, trees, slack = [], {}, 1 - 1e-9
        own_of: dict[int, list[int]] = defaultdict(list)
        for v in ends:
            if (rid := self.region_of.get(v)) in self.regions:
                own_of[rid].append(v)
        for own in own_of.values():
            if len(own) < 2:
                continue
            best, _ = self.tree(own[0])
            best, via = self.tree(max(own, key=lambda v: (best[v], -v)))
            far = max(own, key=lambda v: (best[v], -v))
            top = best[far]
            while far in via and best[via[far][1]] > top / 2:
                far = via[far][1]
            if far not in via:
                continue
            k, near = via[far]
            ahead = top / 2 - best[near]
            one, other = self.tree(near)[0], self.tree(far)[0]
            away = {v: min(one[v] + ahead, other[v] + self.edges[k].length - ahead) for v in own}
            pairs = []
            for v in sorted(own, key=lambda v: (-away[v], v)):
                if 2 * away[v] < top * slack:
                    break
                best, _ = self.tree(v)
                top = max(top, max(best[u] for u in own))
                pairs += [(best[u], min(u, v), max(u, v)) for u in own if u != v and best[u] >= top * slack]
            for a in sorted({a for d, a, _ in pairs if d >= top * slack}):
                best, trees[a] = self.tree(a)
                found += [(best[b], a, b) for b in {b for d, c, b in pairs if c == a and d >= top * slack}]
        return found, trees

    def mean_width(self, chain: list[int]) -> float:
        """The mean of the widths along a chain, weighted by length: half the sum of both ends' for each segment."""
        xy = np.array([self.g.xy[v] for v in chain])
        width = 2 * np.array([self.half_width[self.g.origin[v]] for v in chain])
        step = np.sqrt((np.diff(xy, axis=0) ** 2).sum(axis=1))
        return float(((width[1:] + width[:-1]) / 2 * step).sum() / step.sum()) if step.sum() else float(width.mean())

    def add_loops(self, shortest: float = 0.0) -> None:
        """Quarantined loops whose stem is in use, as loops with that stem."""
        for e in self.loops:
            if (self.part[e.ends[0]] or not self.edges) and e.length >= shortest:
                self.lines.append(Line("loop", e.chain, e.length, stem=e.ends[0]))

    def add_tails(self) -> None:
        """To the ends of trunks and branches at stubs; a line that has its tails keeps them."""
        if self.tail_of is None:
            return
        for line in self.untailed:
            if line.kind in ("trunk", "branch"):
                for end in {line.chain[0], line.chain[-1]}:
                    if self.degree[end] == 1 and (at := self.tail_of(end)) is not None:
                        line.tails[end] = at
        self.untailed = []

    def tailed(self, line: Line) -> float:
        return line.length + sum(float(np.sqrt(((at - np.array(self.g.xy[v])) ** 2).sum())) for v, at in line.tails.items())

    def norm_length(self, line: Line) -> float | None:
        """Twice the length, with tails, over the width at the stem."""
        if line.stem is None:
            return None
        width = 2 * self.half_width[self.g.origin[line.stem]]
        return 2 * self.tailed(line) / width if width else None

    def prune(self, least: float | None = None, most: int | None = None) -> int:
        """Branches of a normalised length below `least` go, and the smallest beyond `most`; then lines that end at a node
        which no other line reaches any more, until nothing changes. How many branches went."""
        self.add_tails()
        branches = sorted((x for x in self.lines if x.kind == "branch"), key=lambda x: (self.norm_length(x) or 0.0, x.chain))
        gone = [x for x in branches if least is not None and (self.norm_length(x) or 0.0) < least]
        if most is not None:
            gone += branches[len(gone) : len(branches) - most]
        for line in gone:
            self.drop(line)
        if gone:
            self.gobble()
        return len(gone)

    def gobble(self) -> None:
        """Delete branches and bridges that end at a node, no stub of the graph, where nothing else is in use."""
        while lost := [x for x in self.lines if x.kind in ("branch", "bridge") and any(self.degree[v] > 1 and self.part[v] <= 1 for v in (x.chain[0], x.chain[-1]))]:
            for line in lost:
                self.drop(line)

    def drop(self, line: Line) -> None:
        """Delete a line; its edges don't come back."""
        # those that go are mostly the last
        del self.lines[next(k for k in range(len(self.lines) - 1, -1, -1) if self.lines[k] is line)]
        if not self.deleted:
            self.deleted = True
            self.unseen.clear()
        inner = [v for v in line.chain[1:-1] if v in self.degree]
        for v in inner:
            self.part[v] -= 2
        for v in (line.chain[0], line.chain[-1]):
            self.part[v] -= 1
        for rid in {self.region_of[v] for v in (*inner, line.chain[0], line.chain[-1]) if v in self.region_of}:
            if rid in self.regions:
                for kind in ("branch", "bridge"):
                    self.known.pop((rid, kind), None)
                for rids in self.unseen.values():
                    rids.add(rid)

    def run(self, o: Options) -> None:
        """Branches, bridges and loops, by the mode's order. PREFER_ looks once and moves out many lines, MAX_ looks anew for each; before
        bridges are exhausted, branches come one by one and are pruned at once."""
        branches, bridges = o.shortest_branch >= 0, o.shortest_bridge >= 0
        least = o.min_normalized_length or None

        def after(moved: int | bool) -> int | bool:
            if moved:
                self.sweep(o.shortest_branch, o.shortest_bridge)
            return moved

        def all_of(kind: str, singly: bool) -> None:
            shortest = o.shortest_branch if kind == "branch" else o.shortest_bridge
            if singly:
                while after(self.one(kind, shortest)):
                    pass
            elif kind == "branch":
                after(self.many(kind, shortest))
            else:
                while after(self.many(kind, shortest)):
                    pass

        def pruned() -> None:
            if least is not None:
                self.prune(least)
            if o.max_branch_count is not None:
                self.prune(most=o.max_branch_count)

        self.sweep(o.shortest_branch, o.shortest_bridge)
        singly = o.mode.startswith("MAX_")
        if o.mode in ("PREFER_BRANCH", "MAX_BRANCH", "MAX_BRANCH_MAX_BRIDGE"):
            if branches:
                all_of("branch", singly)
                pruned()
            if bridges:
                all_of("bridge", o.mode == "MAX_BRANCH_MAX_BRIDGE")
        elif bridges:
            all_of("bridge", singly)
            if branches:
                while after(self.one("branch", o.shortest_branch)):
                    if least is None or not self.prune(least):
                        all_of("bridge", singly)
                pruned()
                all_of("bridge", singly)
        elif branches:
            all_of("branch", True)
            pruned()
        if o.loops and o.shortest_loop >= 0:
            self.add_loops(o.shortest_loop)
        self.add_tails()


@dataclass
class Skeleton:
    status: str
    samples: np.ndarray
    sample_ring: np.ndarray
    voronoi: V.Voronoi | None = None
    is_peripheral: np.ndarray | None = None
    graph: Graph | None = None
    edges: list[Edge] = field(default_factory=list)
    loops: list[Edge] = field(default_factory=list)
    cut_nodes: list[int] = field(default_factory=list)
    partition: Partition | None = None
    test: list[np.ndarray] = field(default_factory=list)


def tails(diagram: V.Voronoi, ring_of: np.ndarray, points: np.ndarray, rings: list[np.ndarray], interval: float, steps: int = 3) -> Callable[[int], np.ndarray | None]:
    """For a stub the boundary point in the middle of the samples around it: the middle sample, or for an even number of steps the
    point of the boundary halfway between. None where they are of several rings or spread over more steps than given."""
    ends = diagram.ridges[:, 2:].T.reshape(-1)
    by_end = np.argsort(ends, kind="stable")
    ends = ends[by_end]
    members = [np.flatnonzero(ring_of == k) for k in range(len(rings))]
    walks = [V.Walk(r[:, :2]) for r in rings]

    def tail(stub: int) -> np.ndarray | None:
        at = by_end[np.searchsorted(ends, stub, "left") : np.searchsorted(ends, stub, "right")]
        near = np.unique(diagram.ridges[at % len(diagram.ridges), :2])
        of = np.unique(ring_of[near])
        if len(of) != 1 or of[0] < 0:
            return None
        own = members[of[0]]
        at, n = near - own[0], len(own)
        for turn in range(len(at)):
            gap = int(((at - at[turn]) % n).max())
            if gap <= steps:
                low = int(at[turn]) - (n if at[turn] + gap >= n else 0)
                if gap % 2 == 0:
                    return points[own[(low + gap // 2) % n]]
                return walks[of[0]].along((low + gap / 2) * interval)
        return None

    return tail


def skeletonize(rings: list[np.ndarray], o: Options) -> Skeleton:
    """The partitioned skeleton of one polygon: ring 0 outside, the others holes; each closed, of 2 or 3 axes."""
    check(o)
    check_rings(rings)
    form, numbers = trunk_form(o.trunk_mode)
    if rings[0].shape[1] == 2 and ("3D" in form or form == "HIGH_LOW" or "RELIEF" in form):
        raise ValueError(f"trunk mode {form} needs heights")
    parts = [V.regular_samples(r, o.interval) for r in rings]
    samples = np.concatenate([p for p, _ in parts])
    ring_of = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
    out = Skeleton("ok", samples, ring_of)
    shortest = min(float(np.sqrt((np.diff(r[:, :2], axis=0) ** 2).sum(axis=1)).min()) for r in rings)
    proxies = [V.proxy_ring(p[:, :2], s) for p, s in parts]
    out.test = [r[:, :2] for r in rings] if shortest >= o.interval else [p for p in proxies if p is not None]
    if len(samples) < 3 or not out.test or proxies[0] is None:
        out.status = "too few samples"
        return out
    xy = np.vstack([samples[:, :2], V.localizers(samples[:, :2])])
    diagram = out.voronoi = V.voronoi(xy)
    ring_all = np.append(ring_of, [-1] * 4)
    out.is_peripheral = V.peripheral(diagram.ridges, ring_all)
    keep = diagram.ridges[~out.is_peripheral & (diagram.ridges[:, 2:] >= 0).all(axis=1)]
    g = out.graph = Graph(diagram.vertices, keep[:, 2:])
    try:
        out.edges, out.loops, out.cut_nodes = isolate(g, out.test, o.cut, o.naive, o.verify)
    except NotIsolated as e:
        out.status = str(e)
        return out
    if o.graph_only:
        return out
    p = out.partition = Partition(g, out.edges, out.loops)
    some = np.zeros(len(diagram.vertices), np.int64)
    z_sum, z_n = np.zeros(len(diagram.vertices)), np.zeros(len(diagram.vertices))
    some[diagram.vertex_of] = diagram.triangles[:, 0]
    p.half_width = np.sqrt(((diagram.vertices - xy[some]) ** 2).sum(axis=1))
    z = None
    if samples.shape[1] == 3:
        heights = np.append(samples[:, 2], [samples[:, 2].mean()] * 4)
        np.add.at(z_sum, diagram.vertex_of, heights[diagram.triangles].mean(axis=1))
        np.add.at(z_n, diagram.vertex_of, 1)
        z = {k: float(z_sum[v] / max(1, z_n[v])) for k, v in enumerate(g.origin)}
    p.z = z
    if o.tails:
        of_vertex = tails(diagram, ring_all, xy, rings, o.interval)
        p.tail_of = lambda v: of_vertex(g.origin[v])
    if form == "NONE":
        return out
    reach = float(np.ptp(np.concatenate([r[:, 2] for r in rings]))) if z else 0.0
    trunks = 0
    while trunks < o.max_trunk_count and p.trunk(form, numbers, z, reach):
        trunks += 1
    if not trunks and form != "DEFAULT":
        out.status = "no path meets the trunk mode"
    p.run(o)
    return out
