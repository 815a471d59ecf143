"""Recursions s = a s + b over long ordered histories, in chunks of rows that many tasks share.

Affine maps compose to affine maps: a chunk is scanned as one map per row, from the chunk's start on, and a table of one row
per chunk carries the state on. A map with a = 0 is a reset.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import numbered
from tidemark.sources.folders import kept

#: Rows of a chunk.
CHUNK = 1 << 17


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps s -> a s + b from the first to each row, as (a, b); by doubling, so no loop goes over the rows."""
    a, b, d = a.astype(float), b.astype(float), 1
    while d < len(a):
        b[d:] = a[d:] * b[:-d] + b[d:]
        a[d:] = a[d:] * a[:-d]
        d *= 2
    return a, b


def in_chunks(rows: DataFrame, key: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """rows with __g (the key as one value, null like any other), __k (place from 1 in the order) and __c (chunk)."""
    return numbered(rows.withColumn("__g", F.struct(*(F.col(c) for c in key))), order, ["__g"]).withColumn("__c", F.floor((F.col("__k") - 1) / chunk))


def running_total(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Chunked rows with the sum of value up to each row; the sum has the type Spark gives it (exact for decimals)."""
    rows = rows.withColumn("__v", value)
    w = Window.partitionBy("__g", "__c").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__g", "__c").agg(F.sum("__v").alias("__t")).withColumn("__at", F.sum("__t").over(earlier)).drop("__t")
    own = rows.withColumn("__own", F.sum("__v").over(w)).join(starts, ["__g", "__c"])
    return own.withColumn(name, F.when(F.col("__at").isNull(), F.col("__own")).otherwise(F.col("__own") + F.col("__at"))).drop("__v", "__own", "__at")


def affine_scan(rows: DataFrame, maps: dict[str, tuple[Column, Column]], seed: float = 0.0) -> DataFrame:
    """Chunked rows with the state `name` after each row, and `name_before` ahead of it, for each recursion name: (a, b)."""
    names, plain = list(maps), rows.columns
    sides = ("a", "b", "p", "q")  # the map up to a row, and up to the row before
    given = rows.withColumns({f"__{n}_{s}": x.cast("double") for n, m in maps.items() for s, x in zip("ab", m, strict=True)})
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"__{n}_{s}", T.DoubleType()) for n in names for s in sides)])

    def scan(t: pa.Table) -> pa.Table:
        t = t.sort_by("__k")
        out = t.select(plain)
        for n in names:
            a, b = composed(t.column(f"__{n}_a").to_numpy(), t.column(f"__{n}_b").to_numpy())
            for s, x in zip(sides, (a, b, np.append(1.0, a[:-1]), np.append(0.0, b[:-1])), strict=True):
                out = out.append_column(f"__{n}_{s}", pa.array(x))
        return out

    local = kept(given.groupBy("__g", "__c").applyInArrow(scan, schema), "scan")
    last = local.groupBy("__g", "__c").agg(F.max_by(F.struct(*(F.col(f"__{n}_{s}") for n in names for s in "ab")), "__k").alias("e")).select("__g", "__c", "e.*")
    carries = T.StructType([last.schema["__g"], last.schema["__c"], *(T.StructField(f"__{n}_at", T.DoubleType()) for n in names)])

    def carry(t: pa.Table) -> pa.Table:
        """One row a chunk: the state that enters it."""
        t = t.sort_by("__c")
        out = t.select(["__g", "__c"])
        for n in names:
            a, b = composed(t.column(f"__{n}_a").to_numpy(), t.column(f"__{n}_b").to_numpy())
            out = out.append_column(f"__{n}_at", pa.array(np.append(seed, (a * seed + b)[:-1])))
        return out

    out = local.join(last.groupBy("__g").applyInArrow(carry, carries), ["__g", "__c"])
    state = lambda n, s, t: F.col(f"__{n}_{s}") * F.col(f"__{n}_at") + F.col(f"__{n}_{t}")
    return out.select(*plain, *(state(n, "a", "b").alias(n) for n in names), *(state(n, "p", "q").alias(f"{n}_before") for n in names))
