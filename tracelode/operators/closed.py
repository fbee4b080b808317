"""Closed patterns without the others: sequences by extension checks on both sides, itemsets by closure.

Both miners grow prefixes level by level. The rows of a prefix are the different windows that support it, with how many
failures each stands for. A prefix whose rows have at most `small` items together is finished in one task; a larger one
takes another step over the whole cluster, in which only counts per prefix and item are gathered. Patterns that aren't
closed are never made beyond one check: a prefix that another item always precedes is dropped with all that it leads to
(sequences), and a set is replaced by its closure at once, met only from its own first place (itemsets).

Counts are of failure windows. Windows without items support nothing; they count among all windows of itemsets and not
among those of sequences, as in the miners of all patterns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators.models import column
from tracelode.sources.shared import written

#: Items of a prefix's rows up to which it is finished in one task.
SMALL = 1_000_000
STATE = "prefix array<string>, items array<string>, n long"
FACTS = "prefix array<string>, kind string, place int, item string, n long"


def tallied(windows: DataFrame, column_: str) -> DataFrame:
    """The different item lists of failure windows that have items, and how many windows have each."""
    rows = windows.where(F.col("is_failure") & (F.size(column_) > 0))
    return rows.groupBy(F.col(column_).alias("items")).agg(F.count("*").alias("n"))


# Sequences.


def ends(prefix: list[str], items: list[str]) -> list[int]:
    """Places of the prefix's first appearance."""
    out, at = [], -1
    for e in prefix:
        at = items.index(e, at + 1)
        out.append(at)
    return out


def lasts(prefix: list[str], items: list[str], end: int) -> list[int]:
    """Places of the prefix's elements as late as they can be before `end`."""
    out = []
    for e in reversed(prefix):
        end = end - 1
        while items[end] != e:
            end -= 1
        out.append(end)
    return out[::-1]


def facts(prefix: list[str], items: list[str]) -> Iterator[tuple[str, int, str]]:
    """What a supporting window says of the prefix, each once: items behind its first appearance ('after'), and by the
    place they would take, items that could be put in ('before'), and those that precede every way to begin ('always')."""
    first = ends(prefix, items)
    for x in set(items[first[-1] + 1 :]):
        yield "after", 0, x
    late, early = lasts(prefix, items, len(items)), lasts(prefix, items, first[-1] + 1)
    begin = 0
    for i, (a, b) in enumerate(zip(late, early, strict=True)):
        for x in set(items[begin:a]):
            yield "before", i, x
        for x in set(items[begin:b]):
            yield "always", i, x
        begin = first[i] + 1


def judged(told: dict, support: int) -> tuple[bool, bool]:
    """Whether the prefix is closed, and whether it may lead to closed ones."""
    full = {kind for (kind, _, _), n in told.items() if n == support}
    return not full & {"after", "before"}, "always" not in full


def grown_sequences(prefix: list[str], rows: list[tuple[list[str], int]], least: int) -> Iterator[tuple[list[str], int]]:
    """The closed sequences that begin with the prefix, from all rows that support it."""
    stack = [(prefix, rows)]
    while stack:
        prefix, rows = stack.pop()
        support, told = sum(n for _, n in rows), Counter()
        for items, n in rows:
            for fact in facts(prefix, items):
                told[fact] += n
        closed, leads = judged(told, support)
        if not leads:
            continue
        if closed:
            yield prefix, support
        for (kind, _, x), n in told.items():
            if kind == "after" and n >= least:
                end = len(prefix)
                stack.append(([*prefix, x], [(items, m) for items, m in rows if x in items[ends(prefix, items)[end - 1] + 1 :]]))


def sequences(windows: DataFrame, min_support: float = 0.05, small: int = SMALL) -> DataFrame:
    """(sequence, n_failure): the closed gapped sequences in at least min_support of the failure windows with events."""
    rows = written(tallied(windows, "items"), "sequences-tallied")
    least = max(1, int(np.ceil(min_support * (rows.agg(F.sum("n")).first()[0] or 0))))
    first = rows.select(F.explode(F.array_distinct("items")).alias("x"), "items", "n").select(F.array("x").alias("prefix"), "items", "n")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for prefix, items, n in zip(*[column(batch, c).to_pylist() for c in ("prefix", "items", "n")], strict=True):
                for kind, place, x in facts(prefix, items):
                    total[tuple(prefix), kind, place, x] += n
            keys = list(total)
            yield pa.record_batch({"prefix": pa.array([list(k[0]) for k in keys], pa.list_(pa.string())), "kind": [k[1] for k in keys], "place": pa.array([k[2] for k in keys], pa.int32()), "item": [k[3] for k in keys], "n": pa.array([total[k] for k in keys], pa.int64())}) if keys else None

    def step(state: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Closed ones among the large prefixes, and the rows of their extensions."""
        summed = state.mapInArrow(lambda b: (x for x in told(b) if x is not None), FACTS).groupBy("prefix", "kind", "place", "item").agg(F.sum("n").alias("n"))
        known = written(summed.join(large, "prefix"), "sequences-facts")
        full = lambda *kinds: F.max((F.col("kind").isin(*kinds) & (F.col("n") == F.col("support"))).cast("int"))
        judged_ = large.join(known.groupBy("prefix").agg(full("after", "before").alias("open"), full("always").alias("dead")), "prefix", "left").fillna(0, ["open", "dead"])
        closed = judged_.where("open = 0 and dead = 0").select(F.col("prefix").alias("sequence"), F.col("support").alias("n_failure"))
        leads = known.where((F.col("kind") == "after") & (F.col("n") >= least)).join(judged_.where("dead = 0").select("prefix"), "prefix").select("prefix", "item")
        later = state.join(leads, "prefix").where(after_holds(F.col("prefix"), F.col("items"), F.col("item")))
        return closed, later.select(F.concat("prefix", F.array("item")).alias("prefix"), "items", "n")

    return mined(first, least, small, step, lambda prefix, some: grown_sequences(prefix, some, least), "sequence")


def after_holds(prefix, items, item):
    """Whether the item comes behind the prefix's first appearance."""
    end = F.aggregate(prefix, F.lit(0), lambda at, e: at + F.array_position(F.slice(items, at + 1, F.size(items)), e).cast("int"))
    return F.array_contains(F.slice(items, end + 1, F.size(items)), item)


def mined(state: DataFrame, least: int, small: int, step: Callable, local: Callable, name: str) -> DataFrame:
    """Small prefixes are finished by `local`, large ones take a `step`; until none is left."""
    out = None
    shape = f"{name} array<string>, n_failure long"

    def finished(key: tuple, t: pa.Table) -> pa.Table:
        rows = list(zip(t["items"].to_pylist(), t["n"].to_pylist(), strict=True))
        found = list(local(list(key[0].as_py()), rows))
        return pa.table({name: pa.array([p for p, _ in found], pa.list_(pa.string())), "n_failure": pa.array([n for _, n in found], pa.int64())})

    while True:
        sizes = state.groupBy("prefix").agg(F.sum("n").alias("support"), F.sum(F.size("items")).alias("volume")).where(F.col("support") >= least)
        sizes = written(sizes, f"{name}-sizes")
        near = state.join(sizes.where(F.col("volume") <= small).select("prefix"), "prefix")
        done = written(near.groupBy("prefix").applyInArrow(finished, shape), f"{name}-closed")
        out = done if out is None else out.unionByName(done)
        large = sizes.where(F.col("volume") > small).select("prefix", "support")
        if large.isEmpty():
            return out
        state = written(state.join(large.select("prefix"), "prefix"), f"{name}-state")
        closed, later = step(state, large)
        out = out.unionByName(written(closed, f"{name}-closed"))
        state = written(later, f"{name}-state")


# Itemsets.


def bitmaps(rows: list[tuple[list[str], int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Items in order, their vertical bitmaps (a bit per row, in bytes), and the rows' weights."""
    items = sorted({x for own, _ in rows for x in own})
    index = {x: j for j, x in enumerate(items)}
    held = np.zeros((len(items), len(rows)), bool)
    for i, (own, _) in enumerate(rows):
        held[[index[x] for x in own], i] = True
    return items, np.packbits(held, axis=1), np.array([n for _, n in rows], np.int64)


def grown_itemsets(prefix: list[str], rows: list[tuple[list[str], int]], least: int) -> Iterator[tuple[list[str], int]]:
    """The closed itemsets that are met from the prefix, from all rows that hold it.

    A closed set is met from its largest item outside the closure of the smaller ones only: an extension whose closure
    has a smaller new item is another set's. A prefix of one item is that item's; a longer one was judged when it was made."""
    items, bits, weight = bitmaps(rows)
    every = np.packbits(np.ones(len(rows), bool))
    count = lambda own: int(weight[np.unpackbits(own, count=len(rows)).astype(bool)].sum())
    closure = lambda own: (bits & own == own).all(axis=1)
    own, last = closure(every), items.index(prefix[-1])
    if len(prefix) == 1 and own[:last].any():
        return
    stack = [(every, own, last)]
    while stack:
        tids, own, last = stack.pop()
        yield [items[j] for j in np.flatnonzero(own)], count(tids)
        for j in range(last + 1, len(items)):
            if not own[j]:
                more = tids & bits[j]
                if count(more) >= least:
                    bigger = closure(more)
                    if np.array_equal(bigger[:j], own[:j]):
                        stack.append((more, bigger, j))


def itemsets(windows: DataFrame, min_support: float = 0.05, small: int = SMALL) -> DataFrame:
    """(itemset, n_failure): the closed itemsets in at least min_support of all failure windows, empty ones counted.

    A prefix is the set of items by which a closed set is met; it ends with the last one (its core)."""
    rows = written(tallied(windows, "item_set"), "itemsets-tallied")
    least = max(1, int(np.ceil(min_support * (windows.agg(F.count_if("is_failure")).first()[0] or 0))))
    first = rows.select(F.explode("items").alias("x"), "items", "n").select(F.array("x").alias("prefix"), "items", "n")

    def step(state: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The closures of the large prefixes, and the rows of those extensions that are met here. Counts per prefix and
        two items tell both: an item is in the closure of an extension where it occurs as often as the extension."""
        core = F.element_at("prefix", -1)
        single = state.select("prefix", F.explode("items").alias("item"), "n").groupBy("prefix", "item").agg(F.sum("n").alias("n"))
        own = written(single.join(large, "prefix").where("n = support").groupBy("prefix", "support").agg(F.array_sort(F.collect_list("item")).alias("closure")), "itemsets-closures")
        mine = own.where((F.size("prefix") > 1) | (F.element_at("closure", 1) >= core))
        closed = mine.select(F.col("closure").alias("itemset"), F.col("support").alias("n_failure"))
        some = state.join(mine.select("prefix", "closure"), "prefix")
        ahead = F.filter("items", lambda x: (x > core) & ~F.array_contains("closure", x))
        pairs = some.select("prefix", "closure", "items", "n", F.explode(ahead).alias("next")).select("prefix", "closure", "next", "n", F.explode("items").alias("item"))
        counted = pairs.groupBy("prefix", "closure", "next", "item").agg(F.sum("n").alias("n"))
        total = counted.where("item = next").select("prefix", "next", F.col("n").alias("all")).where(F.col("all") >= least)
        other = counted.join(total, ["prefix", "next"]).where((F.col("n") == F.col("all")) & (F.col("item") < F.col("next")) & ~F.array_contains("closure", F.col("item")))
        good = written(total.join(other.select("prefix", "next"), ["prefix", "next"], "left_anti").select("prefix", "next"), "itemsets-extensions")
        later = state.join(good, "prefix").where(F.array_contains("items", F.col("next")))
        return closed, later.select(F.concat("prefix", F.array("next")).alias("prefix"), "items", "n")

    return mined(first, least, small, step, lambda prefix, some: grown_itemsets(prefix, some, least), "itemset")
