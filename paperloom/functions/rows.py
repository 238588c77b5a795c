"""Row helpers: values that are evaluated once, and running sums of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the input doesn't have."""
    taken = {c.lower() for c in df.columns}
    tail = next(k for k in range(len(taken) + 1) if not any(f"__{n}{k}" in taken for n in names))
    return [f"__{n}{tail}" for n in names]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once a row, however often they are used (a generator keeps them from being inlined)."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    at = next(n for k in range(len(df.columns) + 1) if (n := f"__once{k}") not in df.columns)
    return df.withColumn(at, one).select(*kept, *[F.col(at).getField(k).alias(k) for k in columns])


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(steps: Column, stretch: int = 512) -> Column:
    """The sum of all items before each item of an array of ints.

    Appending copies an array, so the walk goes in stretches: its cost grows with the length, not with its square.
    """
    ints = lambda kind: F.array().cast(kind)

    def walk(start: Column, c: Column) -> Column:
        part = F.slice(steps, 1 + c * stretch, F.lit(stretch))
        return F.aggregate(part, F.struct(start.alias("end"), ints("array<int>").alias("out")), lambda s, x: F.struct((s["end"] + x).alias("end"), F.array_append(s["out"], s["end"]).alias("out")))

    def join(r: Column, c: Column) -> Column:
        return let(walk(r["end"], c), lambda w: F.struct(w["end"].alias("end"), F.array_append(r["out"], w["out"]).alias("out")))

    chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / stretch).cast("int"))
    zero = F.struct(F.lit(0).alias("end"), ints("array<array<int>>").alias("out"))
    return F.when(F.size(steps) > 0, F.aggregate(chunks, zero, join, lambda r: F.flatten(r["out"]))).otherwise(ints("array<int>"))
