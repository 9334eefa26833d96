"""Measures and edits of lines and rings held as vertex tables (key, i, x, y[, z]).

Every function takes the key columns that tell lines apart and partitions by them alone, so the vertices of a line
meet in one task and lines spread over all; where two functions follow each other Spark keeps the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _axes(v: DataFrame) -> list[str]:
    return [c for c in ("x", "y", "z") if c in v.columns]


def distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Euclidean distance of points given by axis; both must have the same axes."""
    if a.keys() != b.keys():
        raise TypeError("points of unlike dimension")
    return F.sqrt(sum(((b[k] - a[k]) * (b[k] - a[k]) for k in a), F.lit(0.0)))


def segments(v: DataFrame, key: str) -> DataFrame:
    """Each vertex with the next: components dx, dy[, dz], segment_length and the running length before and after.

    The last vertex of a line has no segment and is left out.
    """
    w = W.partitionBy(key).orderBy("i")
    out = v
    for c in _axes(v):
        out = out.withColumn(f"d{c}", F.lead(c).over(w) - F.col(c))
    length = F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in _axes(v)), F.lit(0.0)))
    out = out.withColumn("segment_length", length).filter(F.col("dx").isNotNull())
    after = F.sum("segment_length").over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("cum", after).withColumn("start", F.col("cum") - F.col("segment_length"))


def unit_components(v: DataFrame, key: str) -> DataFrame:
    """Components over length; null for a segment of no length."""
    s = segments(v, key)
    return s.select(key, "i", *[F.try_divide(f"d{c}", "segment_length").alias(f"u{c}") for c in _axes(v)])


def length(v: DataFrame, key: str) -> DataFrame:
    """(key, vertices, length); a line of one vertex has length 0."""
    s = segments(v, key).groupBy(key).agg(F.sum("segment_length").alias("length"))
    n = v.groupBy(key).agg(F.count(F.lit(1)).alias("vertices"))
    return n.join(s, key, "left").select(key, "vertices", F.coalesce("length", F.lit(0.0)).alias("length"))


def envelope(v: DataFrame, key: str) -> DataFrame:
    axes = _axes(v)
    return v.groupBy(key).agg(*[F.min(c).alias(f"min{c}") for c in axes], *[F.max(c).alias(f"max{c}") for c in axes])


def endpoints(v: DataFrame, key: str) -> DataFrame:
    axes = _axes(v)
    return v.groupBy(key).agg(*[F.min_by(c, "i").alias(f"start_{c}") for c in axes], *[F.max_by(c, "i").alias(f"end_{c}") for c in axes])


def flip(v: DataFrame, key: str) -> DataFrame:
    """The vertices of each line in opposite order, numbered from 0 again."""
    i = F.row_number().over(W.partitionBy(key).orderBy(F.desc("i"))) - 1
    return v.withColumn("i", i.cast("long"))


def interpolate(v: DataFrame, distances: DataFrame, key: str, normalized: bool = False) -> DataFrame:
    """Points at distances along lines. distances: (key, d). Adds segment (from 0) and the coordinates.

    A distance falls into the first segment that ends at it or beyond. With `normalized` it is a share of the
    length. Distances below 0 or over the length raise an error, and so does any on a line of one vertex. Segments and
    distances of a line are sorted together once; none meets all others.
    """
    axes = _axes(v)
    s = segments(v, key).select(key, F.struct("i", "cum", "segment_length", *axes, *[f"d{c}" for c in axes]).alias("segment"))
    both = s.withColumn("d", F.lit(None).cast("double")).unionByName(distances.select(key, F.col("d").cast("double").alias("d")), allowMissingColumns=True)
    by_key = W.partitionBy(key)
    at = F.col("d") * F.max("segment.cum").over(by_key) if normalized else F.col("d")
    both = both.withColumn("at", F.coalesce("segment.cum", at))
    # from the far end: the last segment met before a distance is the first that ends there or beyond
    falling = by_key.orderBy(F.desc("at"), F.col("segment").isNull(), F.desc("segment.i")).rowsBetween(W.unboundedPreceding, 0)
    j = both.withColumn("s", F.last("segment", ignorenulls=True).over(falling)).filter("segment is null and d is not null")
    back = F.when((F.col("at") < 0) | F.col("s").isNull(), F.raise_error(F.lit("distance off the line")).cast("double")).otherwise(F.col("at")) - F.col("s.cum")
    j = j.withColumn("back", back)
    return j.select(key, "d", F.col("s.i").alias("segment"), *[(F.col(f"s.{c}") + F.col(f"s.d{c}") + F.coalesce(F.try_divide(f"s.d{c}", "s.segment_length"), F.lit(0.0)) * F.col("back")).alias(c) for c in axes])


def sample_distances(v: DataFrame, key: str, interval: Column | float, vertices: bool = False) -> DataFrame:
    """(key, d): 0, interval, 2 interval, ... below the length; with `vertices` also where vertices after the first lie."""
    step = interval if isinstance(interval, Column) else F.lit(float(interval))
    s = segments(v, key)
    total = s.groupBy(key).agg(F.max("cum").alias("total")).withColumn("step", step)
    ks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("total") / F.col("step"))))
    d = total.select(key, "total", "step", F.explode(ks).alias("__n")).withColumn("d", F.col("__n") * F.col("step")).filter("d < total").select(key, "d")
    return d.unionByName(s.select(key, F.col("cum").alias("d"))) if vertices else d


def sample_regularly(v: DataFrame, key: str, interval: Column | float, vertices: bool = False) -> DataFrame:
    return interpolate(v, sample_distances(v, key, interval, vertices), key)


def sample_normalized(v: DataFrame, key: str, interval: float) -> DataFrame:
    """Points at shares 0, interval, 2 interval, ... below 1 of each length."""
    shares = F.expr(f"filter(transform(sequence(0, cast(ceil(1 / {interval!r}) AS int)), k -> k * {interval!r}D), s -> s < 1)")
    d = v.select(key).distinct().select(key, F.explode(shares).alias("d"))
    return interpolate(v, d, key, normalized=True)


def translate(v: DataFrame, deltas: dict[str, Column | float], negative: bool = False) -> DataFrame:
    sign = -1.0 if negative else 1.0
    return v.withColumns({c: F.col(c) + sign * (d if isinstance(d, Column) else F.lit(float(d))) for c, d in deltas.items()})


def signed_area(v: DataFrame, key: str) -> DataFrame:
    """(key, signed_area) by the shoelace formula on coordinates about the vertex mean; counter-clockwise is positive.

    The ring isn't closed where it is open; its closing vertex counts in the mean.
    """
    w = W.partitionBy(key)
    b = v.select(key, "i", (F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    nxt = w.orderBy("i")
    b = b.withColumn("a", F.col("x") * F.lead("y").over(nxt) - F.lead("x").over(nxt) * F.col("y"))
    return b.groupBy(key).agg((0.5 * F.sum("a")).alias("signed_area"))


def polygon_area(v: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, area, area_ring_sum) of polygons of several rings, ring 0 outside: the area without holes, and the sum of
    all rings' areas."""
    one = F.struct(key, ring)
    a = signed_area(v.withColumn("__k", one), "__k").select("__k.*", F.abs("signed_area").alias("a"))
    return a.groupBy(key).agg(F.sum(F.when(F.col(ring) == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"), F.sum("a").alias("area_ring_sum"))


def listed_polygon_area(vertices: Column) -> Column:
    """The area without holes of a polygon of one part held in its row, as an array of structs (ring, x, y) in order: as
    polygon_area, without a shuffle."""
    ring = lambda k: F.struct(F.filter(vertices, lambda q: q["ring"] == k).alias("p"), k.alias("ring"))
    mean = lambda p, c: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[c]) / F.size(p)
    # each level of structs binds what the next one uses more than once
    rings = F.transform(F.array_distinct(F.transform(vertices, lambda q: q["ring"])), ring)
    rings = F.transform(rings, lambda r: F.struct(r["ring"].alias("ring"), mean(r["p"], "x").alias("mx"), mean(r["p"], "y").alias("my"), r["p"].alias("p")))
    rings = F.transform(rings, lambda r: F.struct(r["ring"].alias("ring"), F.transform(r["p"], lambda q: F.struct((q["x"] - r["mx"]).alias("x"), (q["y"] - r["my"]).alias("y"))).alias("p")))
    crosses = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    area = lambda r: F.when(F.size(r["p"]) > 1, F.abs(0.5 * F.aggregate(crosses(r["p"]), F.lit(0.0), lambda s, c: s + c))).otherwise(0.0)
    return F.aggregate(rings, F.lit(0.0), lambda s, r: s + F.when(r["ring"] == 0, area(r)).otherwise(-area(r)))


def points_in_rings(points: DataFrame, v: DataFrame, key: str, point_key: str) -> DataFrame:
    """(point_key, key) of points inside rings by crossing parity; points on a border may fall either way.

    points: (point_key, px, py). Only the points within a ring's envelope meet its segments, and of those only the
    ones whose y range holds them. Envelopes and points are joined on cells of a grid: a ring's cells are as wide as its
    envelope, to a power of two, so that it has four at most; a point is in one cell of each width that a ring has.
    """
    box = envelope(v, key)
    wide = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    box = box.withColumn("level", F.when(wide > 0, F.greatest(F.ceil(F.log2(wide)), F.lit(-30))).otherwise(-30).cast("int"))
    levels = [r.level for r in box.select("level").distinct().collect()]  # powers of two of the widths: a few tens
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level")).cast("long")
    box = box.withColumn("cx", F.explode(F.sequence(cell("minx"), cell("maxx")))).withColumn("cy", F.explode(F.sequence(cell("miny"), cell("maxy"))))
    placed = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    near = placed.withColumns({"cx": cell("px"), "cy": cell("py")}).join(box, ["level", "cx", "cy"])
    near = near.filter((F.col("px") >= F.col("minx")) & (F.col("px") <= F.col("maxx")) & (F.col("py") >= F.col("miny")) & (F.col("py") <= F.col("maxy")))
    near = near.select(point_key, "px", "py", F.col(key).alias("__ring"))
    s = segments(v, key)
    hit = near.join(s, (F.col("__ring") == F.col(key)) & ((F.col("y") > F.col("py")) != (F.col("y") + F.col("dy") > F.col("py"))))
    hit = hit.filter(F.try_divide("dx", "dy") * (F.col("py") - F.col("y")) + F.col("x") > F.col("px"))
    return hit.groupBy(point_key, key).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select(point_key, key)


def polygon_contains(points: DataFrame, v: DataFrame, key: str, point_key: str, ring: str = "ring") -> DataFrame:
    """(point_key, key) of points inside ring 0 of a polygon and in none of its holes."""
    inside = points_in_rings(points, v.withColumn("__k", F.struct(key, ring)), "__k", point_key).select(point_key, "__k.*")
    return inside.filter(F.col(ring) == 0).select(point_key, key).join(inside.filter(F.col(ring) != 0), [point_key, key], "left_anti")


def collect(v: DataFrame, key: str) -> DataFrame:
    """(key, line): vertices as an array of structs in order."""
    axes = _axes(v)
    line = F.transform(F.array_sort(F.collect_list(F.struct("i", *axes))), lambda p: F.struct(*[p[c].alias(c) for c in axes]))
    return v.groupBy(key).agg(line.alias("line"))


def explode(lines: DataFrame, key: str, column: str = "line") -> DataFrame:
    """Vertices of array lines; the columns of a line stay with its vertices."""
    return lines.select(*[c for c in lines.columns if c != column], F.posexplode(column).alias("i", "p")).select("*", "p.*").drop("p").withColumn("i", F.col("i").cast("long"))
