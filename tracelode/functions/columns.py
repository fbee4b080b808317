"""Column functions: hash-based draws, ordered containment and the special functions that Spark SQL lacks.

All but thinned() are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(*parts: Column | str) -> Column:
    """A reproducible number from 0 to 2**32 - 1: the first 32 bits of the md5 of the parts, joined by bars."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def items(kinds: Column, details: Column) -> Column:
    """kind:detail, place by place."""
    return F.zip_with(kinds, details, lambda a, b: F.concat(a, F.lit(":"), b))


def item_set(seq: Column) -> Column:
    return F.array_sort(F.array_distinct(seq))


def holds_all(seq: Column, pattern: Column) -> Column:
    """Whether every item of the pattern is among those of seq."""
    return F.size(F.array_except(pattern, seq)) == 0


def holds_in_order(seq: Column, pattern: Column) -> Column:
    """Whether the pattern is a subsequence of seq, gaps allowed: the next item wanted advances when it comes."""
    step = lambda i, v: F.when((i < F.size(pattern)) & (F.element_at(pattern, F.least(i + 1, F.size(pattern))) == v), i + 1).otherwise(i)
    return F.when(F.size(pattern) == 0, F.lit(True)).otherwise(F.aggregate(seq, F.lit(0), step) == F.size(pattern))


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 10, then down by the recurrence."""
    y = x.cast("double") + 10
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    down = x.cast("double")
    for k in range(1, 10):
        down = down * (x.cast("double") + k)
    return series - F.ln(down)


def ln_factorials(above: list[Column], below: list[Column]) -> Column:
    """ln of the product of the factorials above over that of those below: the series is stated once for all."""
    one = F.lit(1.0)
    terms = F.array(*[F.struct(one.alias("sign"), (x + 1).alias("x")) for x in above], *[F.struct((-one).alias("sign"), (x + 1).alias("x")) for x in below])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["sign"] * ln_gamma(t["x"]))


def hypergeometric_tail(hit_f: Column, hit_c: Column, n_f: Column, n_c: Column) -> Column:
    """P(X >= hit_f) where X of the hits fall among n_f of the n_f + n_c; 1 where the test is degenerate.

    The tail on the far side of the mean is summed: that of X, or that of the hits among n_c, whose complement it is.
    Its first term is made by ln_gamma, each other one from its neighbour by their ratio. Terms fall at least as fast
    as round the mode, so those beyond 12 standard deviations and 60 more are under one part in 10**17 of the first
    and are left out."""
    hits, total = (hit_f + hit_c).cast("double"), (n_f + n_c).cast("double")
    upward = hit_f > hits * n_f / total
    given = F.struct(
        upward.alias("upward"), hits.alias("k"), total.alias("n"), F.when(upward, n_f).otherwise(n_c).cast("double").alias("m"),
        F.greatest(F.when(upward, hit_f).otherwise(hit_c + 1).cast("double"), F.when(upward, hits - n_c).otherwise(hits - n_f), F.lit(0.0)).alias("first"),
        (12 * F.sqrt(hits * n_f / total * (total - hits) / total * n_c / F.greatest(total - 1, F.lit(1.0))) + 60).alias("most"),
    )

    def tail(g: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            j = g["first"] + i
            term = s["term"] * (g["k"] - j) * (g["m"] - j) / ((j + 1) * (g["n"] - g["k"] - g["m"] + j + 1))
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

        terms = F.least(F.least(g["k"], g["m"]) - g["first"], g["most"]).cast("long")
        steps = F.when(terms > 0, F.sequence(F.lit(0).cast("long"), terms - 1)).otherwise(F.array().cast("array<long>"))
        n, k, m, first = g["n"], g["k"], g["m"], g["first"]
        start = F.exp(ln_factorials([m, n - m, k, n - k], [first, m - first, k - first, n - m - k + first, n]))
        side = start * F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step, lambda s: s["sum"])
        return F.when(terms < 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), side))

    degenerate = (hits == 0) | (hits == total) | (n_f == 0) | (n_c == 0)
    sides = F.transform(F.array(given), lambda g: F.struct(g["upward"].alias("upward"), tail(g).alias("p")))
    return F.when(degenerate, F.lit(1.0)).otherwise(F.aggregate(sides, F.lit(0.0), lambda _, x: F.when(x["upward"], x["p"]).otherwise(1 - x["p"])))


def thinned(df: DataFrame, keys: list[str], gap: int, time: str = "us") -> DataFrame:
    """(keys, time) of the rows at least gap after the last one kept, per keys.

    Whether a row is kept depends on all before it: each key's times pass once, sorted, with the last kept one as the
    only state, so that a key with very many rows needs no more memory than any other."""
    rows = df.select(*keys, time).distinct().repartition(*keys).sortWithinPartitions(*keys, time)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            out = []
            for now, t in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column(time).to_pylist(), strict=True):
                if now != key or t - last >= gap:
                    key, last = now, t
                    out.append(True)
                else:
                    out.append(False)
            yield batch.filter(pa.array(out, pa.bool_()))

    return rows.mapInArrow(kept, rows.schema)


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, by its continued fraction from 2 on and its series below."""
    series, term = x, x
    for k in range(1, 40):
        term = term * (-x * x) / k
        series = series + term / (2 * k + 1)
    fraction = x
    for k in range(60, 0, -1):
        fraction = x + (k / 2.0) / fraction
    return F.when(x < 2, 1 - series * 1.1283791670955126).otherwise(F.exp(-x * x) / fraction * 0.5641895835477563)
