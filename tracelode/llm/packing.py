"""Best-two-fit packing of token pieces into sequences (operator 4).

Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths, which has at most
`capacity` entries however large the corpus is. A bin is filled greedily with the longest lengths that still fit;
then its smallest document makes way for two unpacked ones, if a pair fits the gap so expanded more tightly. The
filled bin is a pattern, repeated as often as its lengths' counts allow. Pieces then take the places of the patterns
by their rank among those of the same length.

Defined cases: a null text is an empty one (one piece with the end id); repeated rows are packed each; a null doc_id is
kept as null; an empty table gives no rows; other columns aren't read; among pairs that fit equally well the first found
(one short, one long) is taken, and pieces of one length take places in the order of their tasks. Documents longer than
the capacity are cut there, in order, however long they are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices, texts_of, written
from tracelode.llm.tokens import encoder


class Lengths:
    """The counts of unpacked pieces by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.left = sorted(self.counts)

    def at_most(self, room: int, taken: Counter) -> int:
        """The longest length up to room of which a piece is left besides those taken; 0 if there is none."""
        i = bisect_right(self.left, room) - 1
        while i >= 0 and self.counts[self.left[i]] <= taken[self.left[i]]:
            i -= 1
        return self.left[i] if i >= 0 else 0

    def two(self, over: int, room: int, taken: Counter) -> tuple[int, int] | None:
        """Of the pairs left with a sum over `over` and up to room, one with the largest sum."""
        best, i, j = None, 0, bisect_right(self.left, room) - 1
        while i <= j:
            a, b = self.left[i], self.left[j]
            if self.counts[b] <= taken[b]:
                j -= 1
            elif a + b > room:
                j -= 1
            else:
                if a + b > over and self.counts[a] - taken[a] >= 1 + (a == b):
                    best, over = (b, a), a + b
                    if over == room:
                        break
                i += 1
        return best

    def remove(self, taken: Counter, times: int) -> None:
        for k, n in taken.items():
            self.counts[k] -= n * times
            if not self.counts[k]:
                del self.counts[k]
                del self.left[bisect_right(self.left, k) - 1]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order, times). The lengths of a bin sum to at most capacity; all pieces are used."""
    rest, out = Lengths(counts), []
    while rest.left:
        taken, lengths, room = Counter(), [], capacity
        while room and (k := rest.at_most(room, taken)):
            taken[k] += 1
            lengths.append(k)
            room -= k
        while room and len(lengths) > 1:
            small = lengths[-1]
            taken[small] -= 1
            pair = rest.two(small, small + room, taken)
            if pair is None:
                taken[small] += 1
                break
            lengths[-1:] = pair
            taken.update(pair)
            lengths.sort(reverse=True)
            room = capacity - sum(lengths)
        taken = +taken
        times = min(rest.counts[k] // n for k, n in taken.items())
        rest.remove(taken, times)
        out.append((lengths, times))
    return out


def places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank, the first sequence and the offset of each run of equal places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given, first = Counter(), 0
    for lengths, times in bins:
        at = 0
        for k in lengths:
            runs.setdefault(k, []).append((given[k], first, at))
            given[k] += times
            at += k
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, dtype: str = "<u2", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and its task and rank among the task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        enc = encoder(tokenizer, dtype)
        for batch, _ in in_slices(batches, text):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column(text)), strict=True):
                raw, n = np.append(ids, ids.dtype.type(end_id)).astype("<u4").tobytes(), len(ids) + 1
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    return texts_of(docs, "doc_id", text=text).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (length, part, nth and any others) with sequence_id and offset.

    Only the histogram reaches the driver: at most `capacity` rows. A piece's rank among those of its length is its
    rank in its task and what the tasks before have; these are sums of a row per length and task, so a length that very
    many pieces share makes no group of pieces.
    """
    table = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    spots = places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    starts = table.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("nth", F.col("before") + F.col("nth")).drop("part", "before")
    names = [c for c in ranked.columns if c != "nth"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            order = np.argsort(lengths, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(some):
                    rank, first, at = spots[int(lengths[some[0]])]
                    run = np.searchsorted(rank, nth[some], side="right") - 1
                    sequence[some], offset[some] = first[run] + nth[some] - rank[run], at[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "nth")
    return ranked.mapInArrow(take, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Per piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces' lengths are written once, as they are read twice: for the histogram and for the places."""
    table = written(pieces_of(docs, tokenizer, end_id, capacity), "pieces")
    return assign(table, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
