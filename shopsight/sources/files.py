"""File feeds (A5): several exported sheets or drops read and unioned by name."""

from __future__ import annotations

import os
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.operators.cleaning import union_feeds

_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both: the wider number, a timestamp for dates, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WIDTH and type(b) in _WIDTH:
        wide = max(type(a), type(b), key=_WIDTH.index)
        whole = {type(a), type(b)} & {T.IntegerType, T.LongType}
        return T.DoubleType() if wide is T.FloatType and whole else wide()
    both = (a, b)
    decimals = [t for t in both if isinstance(t, T.DecimalType)]
    if decimals and all(isinstance(t, T.NumericType) for t in both):
        if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in both):
            return T.DoubleType()
        scale = max(t.scale for t in decimals)
        digits = max(t.precision - t.scale if t in decimals else 19 for t in both)
        return T.DecimalType(min(38, digits + scale), scale)
    if all(isinstance(t, (T.DateType, T.TimestampType)) for t in both):
        return T.TimestampType()
    return T.StringType()


def _partitioned(df: DataFrame, path: str) -> bool:
    below = os.path.basename(path.rstrip("/"))
    return any("=" in folder for f in df.inputFiles() for folder in f.split(below, 1)[-1].split("/")[:-1])


def read_feeds(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
               schema=None, **options) -> DataFrame:
    """Read the paths (parquet, csv, json ...) and union by column name; a column missing in
    one file becomes NULL there.

    Schemas are read first; paths of one schema share one scan, so any number of alike sheets
    is one scan node.  A column whose type differs takes the wider number, else text.  A path
    with partition folders of its own is a scan of its own."""
    def read(of, schema=None):
        r = spark.read.format(fmt).options(**options)
        return (r.schema(schema) if schema is not None else r).load(of)

    groups: dict[tuple, tuple[T.StructType, list[str]]] = {}
    for p in paths:
        df = read(p, schema)
        own = p if _partitioned(df, p) else None
        groups.setdefault((df.schema.json(), own), (df.schema, []))[1].append(p)
    types: dict[str, list[T.DataType]] = {}
    for s, _ in groups.values():
        for f in s:
            types.setdefault(f.name, []).append(f.dataType)
    target = {c: reduce(wider, t) for c, t in types.items()}
    frames = []
    for (_, own), (s, of) in groups.items():
        df = read(own, schema) if own else read(of, s)
        frames.append(df.select(*[F.col(f"`{c}`").cast(target[c]).alias(c) for c in s.names]))
    return union_feeds(frames)
