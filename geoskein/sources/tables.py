"""Geometry tables on disk: Parquet with a WKB column `geometry`, a spatial reference text, and attributes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from geoskein.functions.codec import NAMES, coerce, from_wkb, to_wkb
from geoskein.plans import schema as M

PARTEDNESS = ("COERCE_TO_MULTI", "NATIVE", "EXPLODE", "ERROR_IF_MULTI")
NULLED = ("DROP", "WARN", "ERROR")
MODES = {"a": "append", "w": "overwrite", "x": "errorifexists"}


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _parts(data: pd.Series) -> pd.Series:
    def split(d):
        if d is None:
            return None
        g = from_wkb(d)
        if not g["type"].startswith("Multi"):
            return [d]
        return [to_wkb({"type": g["type"].removeprefix("Multi"), "z": g["z"], "coords": c}) for c in g["coords"]]

    return data.map(split)


@F.pandas_udf(T.BinaryType())
def _multi(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else to_wkb(coerce(from_wkb(d), True)))


def code(geometry) -> F.Column:
    """The type code in the first bytes of little-endian WKB: 1 to 6, 1000 more with z."""
    one = lambda k: F.conv(F.hex(F.substring(geometry, k, 1)), 16, 10).cast("int")
    return one(2) + 256 * one(3)


def read(spark: SparkSession, path: str, partedness: str = "COERCE_TO_MULTI", fields: list[str] | None = None) -> DataFrame:
    """Attributes (all, or those named) and `geometry`: as multi-part, as stored, a row for each part with the same
    attributes, or as single parts with an error where a geometry has several."""
    partedness = M.validate_option(partedness, PARTEDNESS)
    df = spark.read.parquet(path)
    if fields is not None:
        df = df.select(*fields, "geometry")
    if partedness == "COERCE_TO_MULTI":
        return df.withColumn("geometry", _multi("geometry"))
    if partedness == "EXPLODE":
        return df.withColumn("geometry", F.explode_outer(_parts("geometry")))
    if partedness == "ERROR_IF_MULTI":
        parts = _parts("geometry")
        df = df.withColumn("geometry", F.when(F.size(parts) > 1, F.raise_error(F.lit("a geometry has several parts")).cast("binary")).otherwise(F.get(parts, F.lit(0))))
    return df


def same_reference(a: str | None, b: str | None, test_unspecified: bool = False) -> bool:
    """Whether two spatial-reference texts are the same but for blanks and case. None matches all, unless tested."""
    if a is None or b is None:
        return a is b or not test_unspecified
    plain = lambda s: re.sub(r"\s+", "", s).lower()
    return plain(a) == plain(b)


def write(df: DataFrame, path: str, mode: str = "x", reference: str | None = None, nulled_fields: str = "DROP") -> list[str]:
    """Write a geometry table; the names of fields that hold nulls only, which are dropped, kept or an error.

    Mode a appends and demands that what is there has the same number of dimensions and reference, and fields that the
    new ones fit; w replaces, x demands that nothing is there. Nothing is written if a check fails.
    """
    nulled_fields = M.validate_option(nulled_fields, NULLED)
    spark = df.sparkSession
    attributes = df.drop("geometry")
    counts = attributes.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in attributes.columns]).first() if attributes.columns else None
    empty = [c for c in attributes.columns if not counts[c]]
    if empty and nulled_fields == "ERROR":
        raise ValueError(f"fields without values: {empty}")
    if nulled_fields == "DROP":
        df = df.drop(*empty)
    df = df.withColumn("spatial_reference", F.lit(reference).cast("string"))
    if mode == "a":
        try:
            there = spark.read.parquet(path)
        except AnalysisException:
            there = None
        if there is not None:
            old = there.select("spatial_reference", code(F.col("geometry")).alias("c")).filter("c is not null").limit(1).collect()
            new = df.select(code(F.col("geometry")).alias("c")).filter("c is not null").limit(1).collect()
            if old and not same_reference(old[0].spatial_reference, reference):
                raise ValueError("another spatial reference")
            if old and new and (old[0].c % 1000 - 1) % 3 != (new[0].c % 1000 - 1) % 3:
                raise ValueError("geometries of another dimension")
            if old and new and old[0].c > 1000 > new[0].c:
                raise ValueError("2D geometries don't go into a 3D table")
            mine = {f.name: f for f in there.schema}
            for f in df.schema:
                if f.name not in mine:
                    raise ValueError(f"no field {f.name} there")
                if not M.can_fit(T.StructField(f.name, mine[f.name].dataType, True), f):
                    raise ValueError(f"{f.name} doesn't fit")
            df = M.apply(df.withColumns({n: F.lit(None).cast(f.dataType) for n, f in mine.items() if n not in df.columns}), there.schema)
    df.write.mode(MODES[mode]).parquet(path)
    return empty


def information(spark: SparkSession, path: str) -> dict:
    """What is at a path: exists, schema (attributes), geometry_types, has_z, spatial_reference and rows."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return {"exists": False}
    out = {"exists": True, "schema": T.StructType([f for f in df.schema if f.name not in ("geometry", "spatial_reference")]), "rows": df.count()}
    if "geometry" in df.columns:
        codes = [r.c for r in df.select(code(F.col("geometry")).alias("c")).filter("c is not null").distinct().collect()]  # twelve at most
        out |= {"geometry_types": sorted({NAMES[c % 1000] for c in codes}), "has_z": any(c > 1000 for c in codes)}
    if "spatial_reference" in df.columns:
        out["spatial_reference"] = df.agg(F.first("spatial_reference", ignorenulls=True)).first()[0]
    return out


def create(spark: SparkSession, path: str, fields: T.StructType, reference: str | None = None) -> None:
    """An empty geometry table with these attributes; an error where something is there."""
    schema = T.StructType([*fields, T.StructField("geometry", T.BinaryType()), T.StructField("spatial_reference", T.StringType())])
    spark.createDataFrame([], schema).withColumn("spatial_reference", F.lit(reference).cast("string")).write.mode("errorifexists").parquet(path)


def add_fields(df: DataFrame, fields, ignore_name_conflicts: bool = False, ignore_type_conflicts: bool = False) -> DataFrame:
    """df with null columns for the fields. One that is there already is an error unless ignored; then its type must
    fit the field's, unless that is ignored as well."""
    there = {f.name: f for f in df.schema}
    for f in fields:
        if f.name in there and not ignore_name_conflicts:
            raise ValueError(f"the field {f.name} is there already")
        if f.name in there and not ignore_type_conflicts and not M.can_fit(T.StructField(f.name, there[f.name].dataType, True), T.StructField(f.name, f.dataType, True)):
            raise TypeError(f"{f.name} doesn't fit")
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in there})


def delete(spark: SparkSession, path: str) -> bool:
    """Remove the table at a path; whether there was one. What isn't a table of Parquet files raises."""
    if not information(spark, path)["exists"]:
        return False
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
