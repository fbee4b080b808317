"""N-gram Jaccard join with count-vector R-trees (operator 7).

A document is its set of distinct word n-grams (64-bit hashes); equal sets are one node. The hashes fall into groups, a
power of two of them with about eight hashes each, and the group counts are the node's point; a finer point folds
into a coarser one. Of two points, the sum of coordinate minima bounds the overlap of the sets from above. Points that
can be linked meet in blocks. A block gets a packed R-tree of the points folded to ROUGH coordinates, whose inner nodes
hold coordinate maxima and the least size below; a search descends only where the bound reaches the overlap that the
sizes demand, and what reaches the leaves is bounded once more at the pair's finest common groups. Pairs that survive
are verified on the sets themselves, exactly.

Blocks: two sets of similarity t share a hash among the first n - ceil(t n) + 1 of each, in any order that is the same
for all sets. The order here puts frequent hashes last (they are counted over all documents), so that a common passage
fills no block. Blocks of equal members are one. The prefixes remove most pairs; the tree searches what is left.

What survives isn't written as pairs, which copies would multiply: a block joins its nodes to clusters in memory and
emits one row per node. Clusters of all blocks are connected; each node's set goes to its cluster once, where pairs of
nodes that aren't yet linked are bounded at about one hash per group and then counted exactly, and a spanning forest of
the links is emitted. No link between different sets is lost to the components.

Large groups (a hash of over CHUNK sets, a cluster of over TILE nodes) are cut by hash into chunks of that size, so no
task holds one. Each chunk meets about REPS representatives of the whole group; what these connect becomes classes. Only
the members outside the group's largest class then meet all chunks (see cover), and pairs of one class are skipped. A
group of copies costs in proportion to its size; a group of unlike members, each chunk against each.

Defined cases: null and empty texts have no n-grams and are linked with nothing, not even with each other; a text of
fewer words than an n-gram is one n-gram; rows with equal texts are linked; rows with equal doc_id and different texts
are rows of their own; a null doc_id is smaller than all others for one_of_each(), and a component_id only where there is
no other; an empty table gives no rows; very long texts are taken whole; other columns aren't read by linked() and are
kept by one_of_each(), whatever their names. Sets are named by 64-bit hashes: of 10**10 different ones about three pairs
would be taken for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices, own_name, spread_join, written
from tracelode.llm.components import components

ROUGH = 32
#: Bytes of text that are hashed at once.
SLICE = 500_000
#: Hashes whose frequencies are counted together.
COUNTED = 1_500_000
#: Sets are picked out of a scan by a table of 2**BITS bits, which lets a few others pass; a later join drops those.
BITS = 27
#: Members of a block; representatives of a larger group; rows of a frequent hash that one task groups.
CHUNK, REPS, SALTED = 512, 64, 50_000
FAN = 16
#: Nodes of a cluster whose sets are compared in one task.
TILE = 512
#: Hashes that are put last: those in most documents, at most HEAVY of them. The bound affects speed, not results.
HEAVY = 100_000
U = np.uint64
#: White space of the contract, for bytes.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BASE, STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LETTER = mixed(np.arange(1, 257, dtype=U) * BASE)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP to the powers 0..n-1 and their inverses, modulo 2**64."""
    inverse = U(pow(int(STEP), -1, 2**64))
    up, down = np.full(n, STEP, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, with A-Z lower-cased, how many each text has, and the byte of its text where each begins."""
    raws = [t.encode().lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    size = 1 << max(19, int(len(data) - 1).bit_length())
    up, down = powers(size)
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    total = np.cumsum(LETTER[data] * up[: len(data)], dtype=U)
    words = mixed((total[ends - 1] - total[starts - 1]) * down[starts] + (ends - starts).astype(U) * BASE)
    bounds = np.cumsum([0] + [len(r) + 1 for r in raws])
    counts = np.diff(np.searchsorted(starts, bounds + 1))
    return words, counts, starts - 1 - np.repeat(bounds[:-1], counts)


def sets_of(texts: list[str], n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    words, counts, _ = word_hashes(texts)
    if len(words) >= n:
        grams = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            grams = grams * STEP + words[k : len(words) - n + 1 + k]
        grams = mixed(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            own = U(c)
            with np.errstate(over="ignore"):
                for w in words[at : at + c]:
                    own = own * BASE + w
            out.append(mixed(np.array([own], U)))
        else:
            out.append(np.empty(0, U))
        at += c
    return out


def name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def point(s: np.ndarray) -> np.ndarray:
    """Group counts; the largest number of a byte stands for itself and all above."""
    groups = max(ROUGH, 1 << int(len(s) // 8).bit_length())
    return np.minimum(np.bincount((s >> U(7)).astype(np.int64) & (groups - 1), minlength=groups), 255).astype(np.uint8)


class Points:
    """The points of a block's members, folded to each number of groups that some of them have."""

    def __init__(self, raw: list[bytes]):
        self.groups = np.array([len(r) for r in raw])
        own = [np.frombuffer(r, np.uint8).astype(np.int32) for r in raw]
        own = [np.where(x == 255, 1 << 20, x) for x in own]
        self.rough = np.array([x.reshape(-1, ROUGH).sum(axis=0) for x in own])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in np.unique(self.groups).tolist():
            some = np.flatnonzero(self.groups >= g)
            place = np.zeros(len(raw), np.int64)
            place[some] = np.arange(len(some))
            self.at[g] = place, np.array([own[i].reshape(-1, g).sum(axis=0) for i in some])

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of members, at their finest common groups."""
        out = np.zeros(len(a), np.int64)
        common = np.minimum(self.groups[a], self.groups[b])
        for g in np.unique(common).tolist():
            place, table = self.at[g]
            for some in np.array_split(np.flatnonzero(common == g), max(1, len(a) * g >> 22)):
                out[some] = np.minimum(table[place[a[some]]], table[place[b[some]]]).sum(axis=1, dtype=np.int64)
        return out


def least_overlap(sizes, percent: int):
    """The least overlap of sets whose sizes have this sum, at a similarity of percent."""
    return -(-percent * sizes // (100 + percent))


def keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text).alias("row"), F.coalesce(text, F.lit("")).alias("text"))


def rows(columns: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def surveyed(docs: DataFrame, n: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """In one pass, written once: (doc_id, row, node, n, point) per row, and (token, count) of frequent hashes.

    A hash counts where it is in three of some thousand documents of a task; sums over all of these follow."""
    names = ["doc_id", "row", "node", "n", "point", "token", "count"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch, texts in in_slices(batches, chars=SLICE):
            sets = sets_of(texts, n)
            held.extend(sets)
            none = [None] * len(sets)
            yield rows([batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), [name(s) for s in sets], [len(s) for s in sets], [point(s).tobytes() for s in sets], none, none], names, types)
            if sum(map(len, held)) > COUNTED:
                yield counts(held)
                held = []
        if held:
            yield counts(held)

    def counts(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(sets), return_counts=True)
        tokens, times = tokens[times >= 3].view(np.int64), times[times >= 3]
        none = [None] * len(tokens)
        return rows([none, none, none, none, none, tokens, times], names, types)

    table = written(keyed(docs, text).mapInArrow(survey, "doc_id long, row long, node long, n int, point binary, token long, count long"), "survey")
    return table.where("token is null").select("doc_id", "row", "node", "n", "point"), table.where("token is not null").select("token", "count")


def prefixes(docs: DataFrame, heavy: np.ndarray, counts: np.ndarray, n: int, percent: int, text: str = "text") -> DataFrame:
    """(token, salt, hot, node, n) of the hashes in front, once per set and task. heavy: hashes to put last, the rarest
    first, with their counts; those in over CHUNK documents are hot, and the more there are, the more salts they have."""
    order = np.argsort(heavy)
    ranked, salts = heavy[order], np.where(counts > CHUNK, 1 + counts // SALTED, 0)[order]

    def front(s: np.ndarray) -> np.ndarray:
        p = len(s) - -(-percent * len(s) // 100) + 1
        if len(ranked):
            i = np.minimum(np.searchsorted(ranked, s), len(ranked) - 1)
            known = ranked[i] == s
            if known.any():
                light = s[~known]
                if len(light) >= p:
                    return light[:p]
                late = order[i[known]]
                return np.concatenate([light, s[known][np.argsort(late)]])[:p]
        return s[:p]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in in_slices(batches, chars=SLICE):
            tokens, nodes, sizes = [], [], []
            for s in sets_of(texts, n):
                if len(s) and (node := name(s)) not in seen:
                    seen.add(node)
                    f = front(s)
                    tokens.append(f)
                    nodes.append(np.full(len(f), node, np.int64))
                    sizes.append(np.full(len(f), len(s), np.int32))
            if tokens:
                token, node = np.concatenate(tokens), np.concatenate(nodes)
                many = np.zeros(len(token), np.int64)
                if len(ranked):
                    i = np.minimum(np.searchsorted(ranked, token), len(ranked) - 1)
                    many = np.where(ranked[i] == token, salts[i], 0)
                salt = (node % np.maximum(many, 1)).astype(np.int32)
                yield rows([token.view(np.int64), salt, many > 0, node, np.concatenate(sizes)], ["token", "salt", "hot", "node", "n"], [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32()])
            if len(seen) > 1_000_000:
                seen.clear()

    return keyed(docs, text).mapInArrow(emit, "token long, salt int, hot boolean, node long, n int")


def blocks(front: DataFrame) -> DataFrame:
    """(block, token, node, n): members of blocks, and with a token instead the members of large groups.

    Hashes stream through sorted, those of a single set go at once. A group of up to CHUNK nodes is a block, named after
    its members; the rows of a larger one are passed on as they come, so that no task holds it."""
    ordered = front.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "node")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the last token, which may go on
        over = False
        for batch in batches:
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            every = tuple(batch.column(c).to_numpy() for c in ("token", "node", "n"))
            if hot.any():
                yield large(*(x[hot] for x in every))
                every = tuple(x[~hot] for x in every)
            token = every[0]
            if not len(token):
                continue
            if held and held[0][0][0] == token[0]:
                first = int(np.searchsorted(token, token[0], side="right"))
            else:
                first = 0
            if first:
                held.append(tuple(x[:first] for x in every))
                over = over or sum(len(h[0]) for h in held) > 2 * CHUNK
                if over:
                    yield from (large(*h) for h in held)
                    held = [tuple(x[:1] for x in held[-1])]  # the token goes on as a large one
                if first == len(token):
                    continue
            if held and not over:
                yield from members(*(np.concatenate(x) for x in zip(*held, strict=True)))
            last = int(np.searchsorted(token, token[-1]))
            if last > first:
                yield from members(*(x[first:last] for x in every))
            held, over = [tuple(x[last:] for x in every)], False
        if held and not over:
            yield from members(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def large(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(token), pa.int64()), pa.array(token), pa.array(node), pa.array(n)], ["block", "token", "node", "n"])

    def members(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, n = token[fresh], node[fresh], n[fresh]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        ends = np.append(starts[1:], len(token))
        several = np.flatnonzero(ends - starts > 1)
        ids, out = [], []
        known: set[int] = set()
        for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            if b - a > CHUNK:
                yield large(token[a:b], node[a:b], n[a:b])
            elif (block := name(node[a:b].view(U))) not in known:
                known.add(block)
                ids.append(np.full(b - a, block))
                out.append(node[a:b])
        if ids:
            size = sum(map(len, ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.nulls(size, pa.int64()), pa.array(np.concatenate(out)), pa.nulls(size, pa.int32())], ["block", "token", "node", "n"])

    return ordered.mapInArrow(group, "block long, token long, node long, n int").distinct()


def cover(members: DataFrame, size: int, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The edges that judge finds in groups (group, node) of any size; of larger ones enough to connect what all edges do.

    judge takes tiles (tile, node, label), compares the nodes of a tile that differ in label, and returns edges (a, b)
    which connect, with the labels, all that its pairs connect. Groups of up to `size` are one tile. Larger ones are cut
    by hash, never gathered or numbered: first each chunk with the group's representatives; then, of the classes so
    found, what isn't in the largest one of its group with all chunks of the group. Two nodes of different classes are
    in one tile at last, as one of them is outside the largest."""
    sized = members.groupBy("group").agg(F.count("*").alias("m")).where("m > 1").withColumn("w", F.col("m"))
    table = written(spread_join(members.select("group", "node"), sized, ["group"], "w"), "groups")
    big = table.where(F.col("m") > size)
    chunks = F.ceil(F.col("m") / size).cast("int")
    own = table.select(F.xxhash64("group", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("m") > size, chunks).otherwise(1))).alias("tile"), "node")
    chosen = big.where(F.pmod(F.xxhash64("node", F.lit(2)), F.floor(F.col("m") / REPS) + 1) == 0)
    reps = chosen.select(F.col("group"), "node", F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)).alias("chunk")).select(F.xxhash64("group", "chunk").alias("tile"), "node")
    first = written(judge(own.unionByName(reps).distinct().withColumn("label", F.col("node"))), "first")
    if big.isEmpty():
        return first
    labelled = written(big.join(components(first), "node", "left").select("group", "node", "m", F.coalesce("root", "node").alias("label")), "classes")
    classes = labelled.groupBy("group", "label").agg(F.count("*").alias("c"))
    most = classes.groupBy("group").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("w"))
    half = max(1, size // 2)
    rest = F.ceil((F.col("w") - F.col("top.c")) / half).cast("int")
    most = most.select("group", F.col("top.label").alias("main"), rest.alias("rests"), F.ceil(F.col("w") / half).cast("int").alias("alls"), "w").where("rests > 0")
    told = spread_join(labelled, most, ["group"], "w")
    i, j = F.pmod(F.xxhash64("node", F.lit(3)), F.col("rests")).cast("int"), F.pmod(F.xxhash64("node", F.lit(4)), F.col("alls")).cast("int")
    few = told.where("label <> main").select("group", "node", "label", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"))
    every = told.select("group", "node", "label", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), j.alias("j"))
    second = judge(few.unionByName(every).select(F.xxhash64("group", "i", "j").alias("tile"), "node", "label").distinct())
    return first.unionByName(second)


class RTree:
    """A packed R-tree of count vectors, in order of size: inner nodes hold coordinate maxima and the least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, sizes)]
        while len(self.levels[-1][1]) > FAN:
            p, s = self.levels[-1]
            cuts = np.arange(0, len(s), FAN)
            self.levels.append((np.maximum.reduceat(p, cuts), np.minimum.reduceat(s, cuts)))

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and entry places whose bound reaches the overlap demanded."""
        top = len(self.levels[-1][1])
        q, e = np.repeat(np.arange(len(sizes)), top), np.tile(np.arange(top), len(sizes))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, s = self.levels[depth]
            good = np.zeros(len(q), bool)
            for i in range(0, len(q), 100_000):
                a, b = q[i : i + 100_000], e[i : i + 100_000]
                good[i : i + 100_000] = np.minimum(points[a], p[b]).sum(axis=1, dtype=np.int64) >= least_overlap(sizes[a] + s[b], percent)
            q, e = q[good], e[good]
            if depth:
                n = len(self.levels[depth - 1][1])
                q, e = np.repeat(q, FAN), (e[:, None] * FAN + np.arange(FAN)).ravel()
                q, e = q[e < n], e[e < n]
        return q, e


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Whole groups of equal keys from batches that are sorted by key: tables of rows and where their groups begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        fresh = bool(held) and held[-1].column(key)[len(held[-1]) - 1].as_py() != keys[0]
        if not fresh and not len(cuts):
            held.append(batch)
            continue
        end = 0 if fresh else int(cuts[0])
        if held or end:
            yield pa.concat_batches([*held, batch.slice(0, end)]), [0]
        last = int(cuts[-1]) if len(cuts) else 0
        if last > end:
            yield batch.slice(end, last - end), [0, *(c - end for c in cuts.tolist() if end < c < last)]
        held = [batch.slice(last)]
    if held:
        yield pa.concat_batches(held), [0]


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the components that pairs (a, b) of places connect one label."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        to = np.arange(len(labels))
        np.minimum.at(to, high, low)
        while (to[to] != to).any():
            to = to[to]
        labels[:] = to[labels]


def clustered(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) from tiles with points (tile, node, label, n, point): each node that has a partner which the bound leaves
    it, with the first node of those that such pairs and equal labels connect in the tile."""
    ordered = members.repartition("tile").sortWithinPartitions("tile", "n", "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in by_key(batches, "tile"):
            node, label, n, point = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n", "point"))
            n = n.astype(np.int64)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(starts, [*starts[1:], len(node)], strict=True):
                s, ids, points = n[a:b], node[a:b], Points(point[a:b].tolist())
                tree, labels = RTree(points.rough, s), places_of(label[a:b])
                for c in range(0, b - a, 256):
                    q, e = tree.search(points.rough[c : c + 256], s[c : c + 256], percent)
                    q = q + c
                    keep = (e < q) & (labels[e] != labels[q])
                    q, e = q[keep], e[keep]
                    good = points.bounds(q, e) >= least_overlap(s[q] + s[e], percent)
                    joined(labels, q[good], e[good])
                several = np.bincount(labels, minlength=b - a)[labels] > 1
                if several.any():
                    out.append((ids[several], ids[labels[several]]))
            if out:
                yield rows([np.concatenate(x) for x in zip(*out, strict=True)], ["a", "b"], [pa.int64(), pa.int64()])

    return ordered.mapInArrow(search, "a long, b long")


def places_of(labels: np.ndarray) -> np.ndarray:
    """For each label the first place where it stands."""
    _, first, which = np.unique(labels, return_index=True, return_inverse=True)
    return first[which]


def links_of(tiled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the pairs in each tile (tile, node, label) whose sets are similar enough, counted exactly; with
    the labels they connect all that such pairs connect."""
    ordered = tiled.join(sets, "node").repartition("tile").sortWithinPartitions("tile", F.size("grams"), "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in by_key(batches, "tile"):
            out: list[tuple[int, int]] = []
            ids, label = batch.column("node").to_numpy(), batch.column("label").to_numpy()
            grams = batch.column("grams")
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                own = ids[a:b]
                fresh = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))  # rows of equal doc_id and text
                out += forest(own[fresh], [grams[int(a + i)].values.to_numpy().view(U) for i in fresh], percent, places_of(label[a:b][fresh]))
            if out:
                yield rows(list(zip(*out, strict=True)), ["a", "b"], [pa.int64(), pa.int64()])

    return ordered.mapInArrow(verify, "a long, b long")


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the sets (ascending by size) that connect, with equal labels, all that links connect."""
    sizes = np.array([len(s) for s in sets])
    groups = 1 << min(16, max(5, int(sizes.max()).bit_length()))
    table = np.zeros((len(sets), groups), np.uint8)
    open_ = np.zeros(len(sets), bool)  # bounded by nothing
    for i, s in enumerate(sets):
        counts = np.bincount((s >> U(7)).astype(np.int64) & (groups - 1), minlength=groups)
        table[i], open_[i] = np.minimum(counts, 255), counts.max() >= 255
    labels, out = np.arange(len(sets)) if labels is None else labels.copy(), []
    for q in range(1, len(sets)):
        e = np.flatnonzero((labels[:q] != labels[q]) & (sizes[:q] * 100 >= percent * sizes[q]))
        if not len(e):
            continue
        bound = np.minimum(table[e], table[q]).sum(axis=1, dtype=np.int64)
        bound[open_[e] | open_[q]] = 1 << 40
        good = bound >= least_overlap(sizes[e] + sizes[q], percent)
        for i in e[good][np.argsort(-bound[good], kind="stable")].tolist():
            if labels[i] != labels[q]:
                shared = len(np.intersect1d(sets[i], sets[q], assume_unique=True))
                if shared * (100 + percent) >= percent * int(sizes[i] + sizes[q]):
                    out.append((int(ids[q]), int(ids[i])))
                    labels[labels == labels[q]] = labels[i]
    return out


def linked(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, row (a hash of the text), n_shingles, component_id, and which (doc_id, row) stands for
    the component: the smallest, as (first_doc, first_row)."""
    people, counted = surveyed(docs, n, text)
    most = counted.groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(HEAVY)
    found = most.orderBy("count", "token").collect()  # at most HEAVY
    heavy, counts = np.array([r.token for r in found], np.int64).view(U), np.array([r["count"] for r in found], np.int64)
    member = written(blocks(prefixes(docs, heavy, counts, n, percent, text)), "blocks")
    known = people.where("n > 0").groupBy("node").agg(F.min(text_key()).alias("key"), F.first("n").alias("n"), F.first("point").alias("point"))

    def bounded(tiled: DataFrame) -> DataFrame:
        return clustered(tiled.join(known, "node").select("tile", "node", "label", "n", "point"), percent)

    near = bounded(member.where("block is not null").select(F.col("block").alias("tile"), "node", F.col("node").alias("label")))
    large = member.where("token is not null").select(F.col("token").alias("group"), "node")
    if not large.isEmpty():
        near = near.unionByName(cover(large, CHUNK, bounded))
    clusters = written(components(written(near, "near")), "clusters")
    sets = written(picked_sets(docs, known.join(clusters, "node").select("node", "key"), n, text), "sets")
    links = cover(clusters.select(F.col("root").alias("group"), "node"), TILE, lambda tiled: links_of(tiled, sets, percent))
    roots = written(components(written(links, "links")), "roots")
    own = people.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("own"), F.min(first_of()).alias("first"))
    joined = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("own").alias("component_id"), F.min("first").alias("first"), F.count("*").alias("nodes"))
    label = spread_join(joined.select("node", "root"), least, ["root"], "nodes").select("node", "component_id", "first")
    rows_ = people.where("n > 0").groupBy("node").agg(F.count("*").alias("rows"))
    full = spread_join(people.where("n > 0"), label.join(rows_, "node"), ["node"], "rows")
    full = full.select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("first.doc").alias("first_doc"), F.col("first.row").alias("first_row"))
    empty = people.where("n = 0").select("doc_id", "row", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), first_of()["doc"].alias("first_doc"), first_of()["row"].alias("first_row"))
    return full.unionByName(empty)


def first_of():
    """A row's place among those of its component: by doc_id, null before all others, then by its text's hash."""
    return F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.col("row").alias("row"))


def text_key():
    """One number for a row's doc_id and text."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(-(2**63))), "row")


def picked_sets(docs: DataFrame, wanted: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(node, grams) of the texts that wanted (node, key) names, and of few others.

    The keys' places in a table of bits pick them during the scan: the table is gathered as words, at most 2**BITS / 64
    of them, so the texts aren't shuffled."""
    rows_ = keyed(docs, text).withColumn("key", text_key())
    bits = wanted.select(F.pmod("key", F.lit(1 << BITS)).alias("bit")).selectExpr("cast(bit div 64 as int) as word", "shiftleft(1L, cast(bit % 64 as int)) as one")
    words = bits.groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    table = np.zeros((1 << BITS) // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    used = np.flatnonzero(table)
    return rows_.select("key", "text").mapInArrow(grams_of(n, (used, table[used])), "node long, grams array<long>")


def grams_of(n: int, words: tuple[np.ndarray, np.ndarray]):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) // 64, np.int64)
        table[words[0]] = words[1]
        for batch in batches:
            bit = batch.column("key").to_numpy() & ((1 << BITS) - 1)
            batch = batch.filter(pa.array((table[bit >> 6] >> (bit & 63)) & 1 == 1))
            for _, texts in in_slices([batch], chars=SLICE):
                sets = sets_of(texts, n)
                yield rows([[name(s) for s in sets], [s.view(np.int64) for s in sets]], ["node", "grams"], [pa.int64(), pa.list_(pa.int64())])

    return grams


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id and then the smallest hash of the text, and all
    rows without n-grams; all columns stay. Of rows that repeat doc_id and text, one stays."""
    found = linked(docs, n, percent, text)
    doc, row = own_name(docs, "__doc"), own_name(docs, "__row")
    keep = found.where((F.coalesce("doc_id", F.lit(-(2**63))) == F.col("first_doc")) & (F.col("row") == F.col("first_row")))
    keep = written(keep.groupBy(F.col("first_doc").alias(doc), F.col("first_row").alias(row)).agg(F.count("*").alias("count")), "kept")
    kept = docs.withColumns({doc: F.coalesce("doc_id", F.lit(-(2**63))), row: F.xxhash64(text)}).join(keep.select(doc, row), [doc, row], "left_semi")
    if not keep.where("count > 1").isEmpty():  # rows that repeat
        kept = kept.dropDuplicates([doc, row])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
