"""Ranks and running sums over a whole table without sorting it in one task.

Rows are dealt to buckets by their order key; each bucket is sorted on its own, and what lies before it is added from
a table of one row per bucket. Buckets of hashes are their leading bits. For other keys the bounds are keys of the
rows with the smallest hashes of their key (BOUNDS times SPREAD of them), so that they are the same at every
partitioning and when a lost task is run again; a key that very many rows share is one bucket unless the order's last
column tells its rows apart."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.columns import draw
from tracelode.sources.shared import written

#: Bins of a pass over the values of which quantiles are wanted.
BINS = 65_536
#: Buckets of a general order, and rows looked at for each bound.
BOUNDS, SPREAD = 64, 16


def numbered(bucketed: DataFrame, order: list[Column], name: str) -> DataFrame:
    """bucketed (with __b) with the place of each row in the order (__b, *order), from 1."""
    sizes = bucketed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("__n")).alias("__before"))  # a row per bucket
    inside = bucketed.withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    return inside.join(F.broadcast(before), "__b").withColumn(name, (F.col("__before") + F.col("__i")).cast("long")).drop("__b", "__i", "__before")


def ranked_by_draw(df: DataFrame, parts: list[Column | str], ties: list[str], name: str = "place") -> DataFrame:
    """df with each row's place in the order of draw(*parts), then ties."""
    drawn = df.withColumn("__d", draw(*parts))
    return numbered(drawn.withColumn("__b", F.shiftright("__d", 20)), [F.col("__d"), *map(F.col, ties)], name).drop("__d")


def bucketed(df: DataFrame, order: list[Column], bounds_: int = BOUNDS) -> DataFrame:
    """df with __b (int, from 0 to about bounds_), which ascends with the order."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    looked = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(bounds_ * SPREAD)
    bounds = looked.agg(F.array_sort(F.collect_list("k")).alias("__bounds")).select(F.filter("__bounds", lambda _, i: i % SPREAD == SPREAD - 1).alias("__bounds"))
    return df.withColumn("__k", key).join(F.broadcast(bounds)).withColumn("__b", F.size(F.filter("__bounds", lambda b: b < F.col("__k")))).drop("__bounds", "__k")


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place in the ascending order; the order's last column should tell rows apart."""
    return numbered(bucketed(df, order), order, name)


def running(df: DataFrame, by: list[str], order: Column, sums: dict[str, Column], least: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """df with sums (and minima) over the rows before each in ascending order, within the groups of `by`.

    Orders are taken to be distinct within a group, as after a grouping."""
    b = bucketed(df.withColumn("__o", order), [F.col("__o")])
    kinds = {**{k: (F.sum, c) for k, c in sums.items()}, **{k: (F.min, c) for k, c in (least or {}).items()}}
    totals = b.groupBy(*by, "__b").agg(*[f(c).alias(f"__t_{k}") for k, (f, c) in kinds.items()])
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    before = totals.select(*by, "__b", *[f(f"__t_{k}").over(earlier).alias(f"__p_{k}") for k, (f, _) in kinds.items()])
    own = Window.partitionBy(*by, "__b").orderBy("__o").rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    inside = b.withColumns({f"__i_{k}": f(c).over(own) for k, (f, c) in kinds.items()}).join(before, [*by, "__b"])
    whole = {k: F.coalesce(f"__p_{k}", F.lit(0)) + F.coalesce(f"__i_{k}", F.lit(0)) if f is F.sum else F.least(f"__p_{k}", f"__i_{k}") for k, (f, _) in kinds.items()}
    return inside.withColumns(whole).drop("__b", "__o", *[f"__{x}_{k}" for x in "pi" for k in kinds])


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """The exact quantiles of a column of whole numbers, as percentile gives them (interpolated; None without values).

    Spark's percentile holds all different values in one task. Here each pass counts the values that are still in
    question in at most BINS bins a quantile, until a bin is one value: three passes for the microseconds of a month."""
    values = written(df.select(F.col(value).cast("long").alias("v")).where("v is not null"), "values")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return [None] * len(shares)
    spots = [(n - 1) * s for s in shares]
    found: dict[int, int] = {}
    # (first value, last value, values before it) -> places that lie in it
    open_ = {(low, high, 0): sorted({place for x in spots for place in (floor(x), ceil(x))})}
    while open_:
        ranges = {}
        for (first, last, before), places in open_.items():
            if first == last:
                found |= dict.fromkeys(places, first)
            else:
                ranges[first, last, before] = (-(-(last - first + 1) // BINS), places)
        if not ranges:
            break
        bins = F.coalesce(*[F.when(F.col("v").between(first, last), F.struct(F.lit(i).alias("i"), F.expr(f"(v - {first}L) div {width}L").alias("b"))) for i, ((first, last, _), (width, _)) in enumerate(ranges.items())])
        counted = values.select(bins.alias("x")).where("x is not null").groupBy("x.i", "x.b").count().orderBy("i", "b").collect()
        open_ = {}
        for i, ((first, last, before), (width, places)) in enumerate(ranges.items()):
            for r in counted:
                if r.i == i:
                    start = first + r.b * width
                    if own := [place for place in places if before <= place < before + r["count"]]:
                        open_[start, min(start + width - 1, last), before] = own
                    before += r["count"]
    return [float(found[floor(x)]) if found[floor(x)] == found[ceil(x)] else (ceil(x) - x) * found[floor(x)] + (x - floor(x)) * found[ceil(x)] for x in spots]
