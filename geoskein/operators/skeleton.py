"""Skeletons of many polygons at once: one polygon a group, one kernel call, one tagged result table.

Input: a vertex table (poly_id, ring, i, x, y[, z]) with closed rings, ring 0 outside. The kernel's records are
written once to the shared folder; each result is a filter of that table, so asking for several costs one pass.
"""

from __future__ import annotations

import math
from collections.abc import Collection
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoskein.kernel import skeleton as S
from geoskein.operators.lines import length, segments
from geoskein.sources.scratch import materialise

RECORD = (
    "poly_id string, record string, kind string, a long, b long, samp1 long, samp2 long, idxs array<long>, xs array<double>, ys array<double>, zs array<double>, "
    "widths array<double>, length2d double, untailed_length2d double, norm_length double, untailed_norm_length double, stem_width double, x double, y double, z double, graph_degree long, part_degree long, status string"
)
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


#: What may be asked for, beside the status that every polygon has.
OUTPUTS = ("sample", "test_ring", "vor_vertex", "vor_ridge", "graph_edge", "cut_node", "line", "node")


def records(poly_id: str, rings: list[np.ndarray], o: S.Options, outputs: Collection[str] = OUTPUTS) -> list[dict]:
    """What the kernel finds for a polygon, a dict for each record of the kinds asked for. A failure is a status, not an exception."""
    try:
        out = S.skeletonize(rings, o)
    except (ValueError, ArithmeticError, LookupError) as e:
        return [{"poly_id": poly_id, "record": "polygon", "status": f"failed: {e}"}]
    made = [{"record": "polygon", "status": out.status, "a": len(out.samples)}]
    for k, (p, r) in enumerate(zip(out.samples, out.sample_ring) if "sample" in outputs else ()):
        made.append({"record": "sample", "a": k, "b": int(r), "x": p[0], "y": p[1], "z": p[2] if len(p) > 2 else None})
    made += [{"record": "test_ring", "a": k, "xs": t[:, 0], "ys": t[:, 1]} for k, t in enumerate(out.test)]
    if out.voronoi is not None and {"vor_vertex", "vor_ridge"} & set(outputs):
        made += [{"record": "vor_vertex", "a": k, "x": p[0], "y": p[1]} for k, p in enumerate(out.voronoi.vertices)]
        for (s1, s2, v1, v2), edge in zip(out.voronoi.ridges.tolist(), out.is_peripheral):
            made.append({"record": "vor_ridge", "samp1": s1, "samp2": s2, "a": v1, "b": v2, "kind": "peripheral" if edge else "nonperipheral"})
    if out.graph is not None:
        xy = out.graph.xy
        for kind, edges in (("graph", out.edges), ("quarantined_loop", out.loops)):
            for e in edges if "graph_edge" in outputs else ():
                made.append({"record": "graph_edge", "kind": kind, "a": e.ends[0], "b": e.ends[1], "idxs": e.chain, "xs": [xy[v][0] for v in e.chain], "ys": [xy[v][1] for v in e.chain], "length2d": e.length})
        made += [{"record": "cut_node", "a": v, "x": xy[v][0], "y": xy[v][1]} for v in out.cut_nodes]
        if (p := out.partition) is not None:
            height = p.z
            for line in p.lines if "line" in outputs else ():
                pts = [np.array(xy[v]) for v in line.chain]
                zs = [height[v] for v in line.chain] if height else None
                before, after = line.tails.get(line.chain[0]), line.tails.get(line.chain[-1])
                full = [before] * (before is not None) + pts + [after] * (after is not None)
                stem_width = None if line.stem is None else 2 * float(p.half_width[out.graph.origin[line.stem]])
                made.append({
                    "record": "line", "kind": line.kind, "a": line.chain[0], "b": line.chain[-1], "idxs": line.chain, "xs": [q[0] for q in full], "ys": [q[1] for q in full], "zs": zs,
                    "widths": [2 * float(p.half_width[out.graph.origin[v]]) for v in line.chain], "length2d": p.tailed(line), "untailed_length2d": line.length, "norm_length": p.norm_length(line),
                    "untailed_norm_length": 2 * line.length / stem_width if stem_width else None, "stem_width": stem_width,
                })
            for v in sorted(p.degree) if "node" in outputs else ():
                kind = {1: "stub", 2: "binode", 3: "hub"}.get(p.degree[v], "hyperhub")
                made.append({"record": "node", "kind": kind, "a": v, "x": xy[v][0], "y": xy[v][1], "z": height[v] if height else None, "graph_degree": p.degree[v], "part_degree": p.part[v]})
    return [{"poly_id": poly_id} | m for m in made if m["record"] == "polygon" or m["record"] in outputs]


def preflight(v: DataFrame, interval: Column | float) -> DataFrame:
    """(poly_id, perimeter, est_samples) before any kernel runs."""
    key = F.struct("poly_id", "ring")
    step = interval if isinstance(interval, Column) else F.lit(float(interval))
    p = length(v.withColumn("__k", key), "__k").select("__k.poly_id", "length").groupBy("poly_id").agg(F.sum("length").alias("perimeter"))
    return p.withColumn("est_samples", F.ceil(F.col("perimeter") / step))


def estimated_interval(v: DataFrame, target_gb: float) -> DataFrame:
    """(poly_id, perimeter, interval): the smallest interval whose samples fill a memory target, with its margin."""
    return preflight(v, 1.0).select("poly_id", "perimeter", (F.col("perimeter") / ((target_gb * 1e9 - 2e8) * 3.26e-4) * 1.2).alias("interval"))


def max_node_count(target_bytes: float, used_bytes: float = 0.0) -> int:
    """Contracted nodes that all-pairs routing may have within a memory target."""
    return int(0.9 * math.sqrt(max(0.0, target_bytes - used_bytes) / 18))


def rotated(v: DataFrame) -> DataFrame:
    """Every ring begun at its second vertex: the retry after a failed isolation."""
    w = W.partitionBy("poly_id", "ring")
    n = F.max("i").over(w)
    moved = v.filter("i > 0 OR i IS NULL").withColumn("i", F.col("i") - 1)
    first = v.withColumn("n", n).filter("i = 1").withColumn("i", F.col("n")).drop("n")
    return moved.unionByName(first)


class Skeletons:
    """Lazy tables over one written pass of the kernel."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _of(self, record: str, *columns) -> DataFrame:
        return self.table.filter(F.col("record") == record).select("poly_id", *columns)

    def status(self) -> DataFrame:
        return self._of("polygon", "status", F.col("a").alias("samples"))

    def samples(self) -> DataFrame:
        return self._of("sample", F.col("a").alias("samp_idx"), F.col("b").alias("ring"), "x", "y", "z")

    def test_polygons(self) -> DataFrame:
        return self._of("test_ring", F.col("a").alias("ring"), "xs", "ys")

    def vertices(self) -> DataFrame:
        return self._of("vor_vertex", F.col("a").alias("vor_idx"), "x", "y")

    def ridges(self) -> DataFrame:
        return self._of("vor_ridge", "kind", "samp1", "samp2", F.col("a").alias("from_vor"), F.col("b").alias("to_vor"))

    def graph_edges(self) -> DataFrame:
        return self._of("graph_edge", "kind", F.col("a").alias("from_vor"), F.col("b").alias("to_vor"), F.col("idxs").alias("vor_idxs"), "xs", "ys", "length2d")

    def cut_nodes(self) -> DataFrame:
        return self._of("cut_node", F.col("a").alias("vor_idx"), "x", "y")

    def lines(self, *kinds: str) -> DataFrame:
        """Partitioned lines, of the kinds asked for or all; loops carry their stem's width like branches."""
        out = self._of("line", "kind", F.col("a").alias("from_vor"), F.col("b").alias("to_vor"), F.col("idxs").alias("vor_idxs"), "xs", "ys", "zs", "widths", "length2d", "untailed_length2d", "norm_length", "untailed_norm_length", "stem_width")
        return out.filter(F.col("kind").isin(*kinds)) if kinds else out

    def measures(self) -> DataFrame:
        """A line's key with what its vertices tell: counts without tails, length in space, rise, area, mean width, stem and stub.

        A segment's width is the mean of those at its ends, and its area that width by its length. Heights are null in 2D.
        """
        at = lambda c, k: F.get(c, F.lit(k) if isinstance(k, int) else k)
        own = self.lines()
        n = F.size("vor_idxs")
        # tails stand before and after the vertices
        before = F.when(F.col("kind").isin("trunk", "branch"), F.size("xs") - n).otherwise(0)
        of_node = self._of("node", F.col("a").alias("node"), F.col("x").alias("node_x"), F.col("y").alias("node_y"))
        own = own.join(of_node, (own.poly_id == of_node.poly_id) & (own.from_vor == of_node.node), "left").drop(of_node.poly_id)
        first = F.when(at("xs", 0).eqNullSafe(F.col("node_x")) & at("ys", 0).eqNullSafe(F.col("node_y")), 0).otherwise(F.least(before, F.lit(1)))
        part = lambda c: F.slice(c, first + 1, n)
        own = own.withColumns({"vx": part("xs"), "vy": part("ys"), "last": n - 2})
        steps = lambda body: F.transform(F.sequence(F.lit(0), F.col("last")), body)
        d = lambda c, k: F.get(c, k + 1) - F.get(c, k)
        flat = lambda k: F.sqrt(d("vx", k) * d("vx", k) + d("vy", k) * d("vy", k))
        wide = lambda k: (F.get("widths", k) + F.get("widths", k + 1)) / 2
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        own = own.withColumns({"segment_widths": steps(wide), "area": total(steps(lambda k: flat(k) * wide(k))), "length3d": F.when(F.col("zs").isNotNull(), total(steps(lambda k: F.sqrt(flat(k) * flat(k) + d("zs", k) * d("zs", k)))))})
        side = F.col("kind").isin("branch", "loop")
        return own.select(
            "poly_id", "kind", "from_vor", "to_vor", n.alias("vertex_count"), (n - 1).alias("segment_count"), "segment_widths", "area", (F.col("area") / F.col("untailed_length2d")).alias("mean_width"),
            "length3d", (F.element_at("zs", -1) - at("zs", 0)).alias("delta_z"), F.when(side, at("vx", 0)).alias("stem_x"), F.when(side, at("vy", 0)).alias("stem_y"),
            F.when(F.col("kind") == "branch", F.element_at("vx", -1)).alias("stub_x"), F.when(F.col("kind") == "branch", F.element_at("vy", -1)).alias("stub_y"),
        )

    def nodes(self, kind: str = "all") -> DataFrame:
        """Nodes of the graph: all, stub, hub, binode, hyperhub, nonbinode, trunk, branch, branch_stem, branch_stub, bridge,
        loop, end; `next_` before one of the line kinds keeps what is in use already."""
        n = self._of("node", "kind", F.col("a").alias("vor_idx"), "x", "y", "z", "graph_degree", "part_degree")
        if kind == "all":
            return n
        if kind in ("stub", "hub", "binode", "hyperhub"):
            return n.filter(F.col("kind") == kind)
        if kind == "nonbinode":
            return n.filter("kind != 'binode'")
        after = kind.startswith("next_")
        base = kind.removeprefix("next_")
        ends = {"branch_stem": ("branch", ["from_vor"]), "branch_stub": ("branch", ["to_vor"]), "loop": ("loop", ["from_vor"]), "end": (None, ["from_vor", "to_vor"])}
        of, columns = ends.get(base, (base, ["from_vor", "to_vor"]))
        rows = self.lines(*([of] if of else []))
        ids = rows.select("poly_id", F.explode(F.array(*columns)).alias("vor_idx")).distinct()
        out = n.join(ids, ["poly_id", "vor_idx"], "left_semi")
        return out.filter("part_degree != 0") if after else out

    def downslope(self) -> DataFrame:
        """Lines turned so that they don't rise from start to end."""
        up = F.element_at("zs", -1) > F.col("zs")[0]
        turn = {c: F.when(up, F.reverse(c)).otherwise(F.col(c)) for c in ("vor_idxs", "xs", "ys", "zs")}
        swap = {"from_vor": F.when(up, F.col("to_vor")).otherwise(F.col("from_vor")), "to_vor": F.when(up, F.col("from_vor")).otherwise(F.col("to_vor"))}
        return self.lines().withColumns(turn | swap)


def skeletonize(v: DataFrame, interval: float, max_samples: int | None = None, retry_rotated: bool = True, isolation_mode: str = "", outputs: Collection[str] = OUTPUTS, **options) -> Skeletons:
    """Skeletons of every polygon. options: fields of kernel.skeleton.Options; isolation_mode: some of its flags as one text,
    as CUT_NAIVE_VERIFY; outputs: the kinds of records to write, the status beside them. Options that no polygon can be made with raise here.

    A polygon that is none (short or open rings, coordinates that aren't finite) or fails has a status alone. Polygons whose samples would be more than max_samples are left out of the kernel and have a status only. Where
    isolation fails, the rings are begun at their next vertex and the kernel tries once more.
    """
    o = S.Options(interval, **(S.isolation_flags(isolation_mode) | options))
    S.check(o)
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    axes = [c for c in ("x", "y", "z") if c in v.columns]
    v = v.withColumn("poly_id", F.col("poly_id").cast("string"))
    refused = None
    if max_samples is not None:
        sizes = preflight(v, interval)
        refused = sizes.filter(F.col("est_samples") > max_samples)
        v = v.join(refused, "poly_id", "left_anti")

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = S.Options(**asdict(o))
        rings = [g.sort_values("i")[axes].to_numpy(np.float64) for _, g in pdf.groupby("ring", sort=True)]
        made = records(key[0], rings, own, outputs)
        if retry_rotated and "isolated" in made[0]["status"]:
            made = records(key[0], [np.vstack([r[1:], r[1:2]]) for r in rings], own, outputs)
        blank = dict.fromkeys(_NAMES)
        return pd.DataFrame([blank | m for m in made], columns=_NAMES).astype({c.split()[0]: "Int64" for c in RECORD.split(", ") if c.endswith(" long")})

    # a given number of partitions: what is few bytes is much work, and must not be coalesced
    parts = 4 * int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = v.repartition(parts, "poly_id").groupBy("poly_id").applyInPandas(kernel, RECORD)
    if refused is not None:
        over = refused.select("poly_id", F.lit("polygon").alias("record"), F.col("est_samples").alias("a"), F.lit("too many samples").alias("status"))
        table = table.unionByName(over, allowMissingColumns=True)
    return Skeletons(materialise(table, "skeletons"))


def boundary_samples(v: DataFrame, interval: float) -> DataFrame:
    """(poly_id, ring, samp_idx, segment, x, y) without a kernel: regular samples of each ring, numbered through the polygon."""
    from geoskein.operators.lines import sample_regularly

    s = sample_regularly(v.withColumn("__k", F.struct("poly_id", "ring")), "__k", interval)
    at = F.row_number().over(W.partitionBy("__k.poly_id").orderBy("__k.ring", "d")) - 1
    return s.select("__k.poly_id", "__k.ring", at.cast("long").alias("samp_idx"), "segment", "x", "y")


def proxy_rings(samples: DataFrame) -> DataFrame:
    """(poly_id, ring, i, x, y): first and last sample of each boundary segment, closed; rings of under three samples go."""
    w = W.partitionBy("poly_id", "ring")
    by = w.orderBy("samp_idx")
    s = samples.withColumn("n", F.count(F.lit(1)).over(w)).filter("n >= 3")
    s = s.withColumn("edge", (F.coalesce(F.lag("segment").over(by), F.lit(-1)) != F.col("segment")) | (F.coalesce(F.lead("segment").over(by), F.lit(-1)) != F.col("segment"))).filter("edge")
    s = s.withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = F.when(F.col("i") == 0, F.array(F.lit(0).cast("long"), F.col("n"))).otherwise(F.array(F.col("i").cast("long")))
    return s.select("poly_id", "ring", F.explode(at).alias("i"), "x", "y")


def binary_tree(spark, trunk_length: float, length_factor: float, angle: float, generations: int, base: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(generation, x0, y0, x1, y1): a symmetric tree of 2^(generations+1) - 1 segments, each turned by +-angle degrees."""
    frame = spark.createDataFrame([(0, base[0], base[1], base[0], base[1] + trunk_length, math.pi / 2)], "generation int, x0 double, y0 double, x1 double, y1 double, heading double")
    out, turn = frame, math.radians(angle)
    for g in range(1, generations + 1):
        size = trunk_length * length_factor**g
        frame = frame.withColumn("heading", F.explode(F.array(F.col("heading") + turn, F.col("heading") - turn)))
        frame = frame.select(F.lit(g).alias("generation"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), (F.col("x1") + size * F.cos("heading")).alias("x1"), (F.col("y1") + size * F.sin("heading")).alias("y1"), "heading")
        out = out.unionByName(frame)
    return out.drop("heading")


def tree_lines(tree: DataFrame, vertices: int = 10, offset: float = 0.0, seed: int = 0) -> DataFrame:
    """(generation, x0, y0, i, x, y): every segment of a tree as a line of so many vertices. Those between its ends are
    moved by up to offset times its length along either axis, by hashes of place and seed."""
    n = vertices - 1
    v = tree.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("share", F.col("i") / n)
    size = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    noise = lambda axis: 2 * F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), "x0", "y0", "x1", "y1", "i"), F.lit(1 << 30)) / F.lit(float(1 << 30)) - 1
    moved = lambda axis: F.when(F.col("i").between(1, n - 1), noise(axis) * offset * size).otherwise(0.0)
    at = lambda c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("share") + moved(c)
    return v.select("generation", "x0", "y0", "x1", "y1", "i", at("x").alias("x"), at("y").alias("y"))


def segment_table(v: DataFrame) -> DataFrame:
    """Boundary segments of each ring with their lengths."""
    return segments(v.withColumn("__k", F.struct("poly_id", "ring")), "__k").select("__k.*", "i", "segment_length")
