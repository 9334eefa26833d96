"""Schema algebra over StructType: fitting, promotion, set operations, inference."""

from __future__ import annotations

import re
from ast import literal_eval

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole-number types by width, then what they widen to.
INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
LIMITS = [(t, -(2 ** (8 * n - 1)), 2 ** (8 * n - 1) - 1) for t, n in zip(INTEGERS, (1, 2, 4, 8))]
NUMBERS = [*INTEGERS, T.FloatType(), T.DoubleType()]


def field(name: str, kind: T.DataType, nullable: bool = True, width: int | None = None) -> T.StructField:
    """A string's width stands in the metadata."""
    return T.StructField(name, kind, nullable, {"width": width} if width is not None else {})


def width(f: T.StructField) -> int | None:
    return f.metadata.get("width")


def can_fit(target: T.StructField, source: T.StructField) -> bool:
    """Whether values of source fit target: same kind and no wider, not null where target mustn't be."""
    if source.nullable and not target.nullable:
        return False
    a, b = target.dataType, source.dataType
    if a == b:
        return not (width(target) is not None and (width(source) is None or width(source) > width(target))) if isinstance(a, T.StringType) else True
    if a in NUMBERS and b in NUMBERS:
        if a == T.FloatType():
            return b in INTEGERS[:2]
        return NUMBERS.index(b) <= NUMBERS.index(a)
    return False


def promote(a: T.StructField, b: T.StructField) -> T.StructField:
    """The narrowest field that fits both. Numbers widen to numbers, strings to longer ones; other mixtures are errors."""
    nullable = a.nullable or b.nullable
    if isinstance(a.dataType, T.StringType) and isinstance(b.dataType, T.StringType):
        sizes = [width(a), width(b)]
        return field(a.name, a.dataType, nullable, None if None in sizes else max(sizes))
    if a.dataType == b.dataType:
        return field(a.name, a.dataType, nullable)
    for kind in NUMBERS:
        f = field(a.name, kind, nullable)
        if can_fit(f, a) and can_fit(f, b):
            return f
    raise TypeError(f"{a.dataType.simpleString()} and {b.dataType.simpleString()} have no common type for {a.name}")


def _merged(a: T.StructField, b: T.StructField, may: bool) -> T.StructField:
    if may:
        return promote(a, b)
    if not can_fit(a, b):
        raise TypeError(f"{b.name} doesn't fit")
    return a


def union(a: T.StructType, b: T.StructType, promoting: bool = False) -> T.StructType:
    """Fields of a in order, then new ones of b; common ones must fit, or are promoted."""
    other = {f.name: f for f in b}
    return T.StructType([_merged(f, other[f.name], promoting) if f.name in other else f for f in a] + [f for f in b if f.name not in a.names])


def intersection(a: T.StructType, b: T.StructType, promoting: bool = False) -> T.StructType:
    other = {f.name: f for f in b}
    return T.StructType([_merged(f, other[f.name], promoting) for f in a if f.name in other])


def difference(a: T.StructType, names) -> T.StructType:
    names = set(names.names if isinstance(names, T.StructType) else names)
    return T.StructType([f for f in a if f.name not in names])


def symmetric_difference(a: T.StructType, b: T.StructType) -> T.StructType:
    return T.StructType([*difference(a, b), *difference(b, a)])


def subset(a: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([a[n] for n in names])


def order_by(a: T.StructType, names: list[str], ignore_unrecognized: bool = False, ignore_missing: bool = False) -> T.StructType:
    """Fields in the order named; unnamed ones follow if missing names are ignored."""
    unknown, missing = [n for n in names if n not in a.names], [n for n in a.names if n not in names]
    if unknown and not ignore_unrecognized:
        raise ValueError(f"no such fields: {unknown}")
    if missing and not ignore_missing:
        raise TypeError(f"fields not named: {missing}")
    return subset(a, [n for n in names if n in a.names] + missing)


def extend(a: T.StructType, fields) -> T.StructType:
    """Fields of a, then the others; a name that is there already is an error."""
    new = list(fields)
    if again := [f.name for f in new if f.name in a.names]:
        raise ValueError(f"fields are there already: {again}")
    return T.StructType([*a, *new])


def apply(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema, cast to its types. A column that isn't there is null, or an error where it mustn't be."""
    if missing := [f.name for f in schema if f.name not in df.columns and not f.nullable]:
        raise ValueError(f"no columns for the fields {missing}")
    df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def profile(df: DataFrame) -> DataFrame:
    """(field, n, nulls, least, most, width, low, high): one row for each column, from one pass over the table; low and high
    are the bounds of whole numbers, exactly."""
    sums = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, T.NumericType)
        text = isinstance(f.dataType, T.StringType)
        whole = f.dataType in INTEGERS
        none = F.lit(None).cast("long")
        sums.append(F.struct(
            F.lit(f.name).alias("field"), F.count(c).alias("n"), F.count(F.when(c.isNull(), 1)).alias("nulls"), (F.min(c).cast("double") if number else F.lit(None).cast("double")).alias("least"),
            (F.max(c).cast("double") if number else F.lit(None).cast("double")).alias("most"), (F.max(F.char_length(c)) if text else F.lit(None).cast("int")).cast("long").alias("width"),
            (F.min(c).cast("long") if whole else none).alias("low"), (F.max(c).cast("long") if whole else none).alias("high"),
        ))
    return df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def infer(df: DataFrame, minimize: bool = True) -> tuple[T.StructType, list[str]]:
    """(schema, names of columns that are all null): whole numbers as narrow as their values allow, strings as wide as
    the longest. Without minimizing, types stay and only nullability is found."""
    rows = {r.field: r for r in profile(df).collect()}  # a row for each column
    fields = []
    for f in df.schema:
        r, kind, wide = rows[f.name], f.dataType, None
        if minimize and kind in INTEGERS and r.n:
            kind = next(t for t, low, high in LIMITS if low <= r.low and r.high <= high)
        if minimize and isinstance(kind, T.StringType):
            wide = r.width
        fields.append(field(f.name, kind, bool(r.nulls), wide))
    return T.StructType(fields), [n for n, r in rows.items() if not r.n]


def read_settings(text: str) -> dict:
    """Lines `name = literal`; # starts a comment, and triple-quoted blocks are comments too."""
    out = {}
    for line in re.sub(r"('''|\"\"\").*?\1", "", text, flags=re.S).splitlines():
        name, eq, value = line.partition("=")
        if eq and re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name):
            out[name.strip()] = literal_eval(re.sub(r"(?<=[\]\)\}\w'\"])\s+#.*$", "", value.strip()))
    return out


def validate_option(value: str, options: tuple[str, ...]) -> str:
    """The option that value spells in any case; # in an option stands for a number."""
    for o in options:
        if re.fullmatch(re.escape(o).replace(r"\#", r"[-+]?\d+(?:\.\d+)?%?"), value, re.I):
            return value.upper() if "#" in o else o
    raise ValueError(f"{value!r} is none of {options}")
