"""Merkle manifest of a dataset: every row is a leaf, every leaf gets its proof up to one root.

Leaves of a source ascend by doc_id and are hashed up in runs of FANOUT; the sources' roots, in the order of their
names, are hashed up likewise. The proofs come from a butterfly exchange: leaves lie in aligned blocks of FANOUT **
levels; each block hashes its own subtree, and then, round by round, the aligned groups of FANOUT blocks that differ in
one digit of their number swap the roots they hold. Each block hashes the common ancestor itself (so FANOUT ** r blocks
hash the same one in round r), notes what the others sent, and after the last round has the upper proof of all its
leaves: nothing is sent down again.

Of the texts only digests travel. A block has at most FANOUT ** levels rows, a swap at most FANOUT, so a source with a
third of all rows is as many blocks as it needs. The rounds are as many as digits in the largest number of blocks, and
each is written, so a lost executor repeats one round at most.

Cases: a null field is `-`, so it differs from an empty text; a null doc_id sorts first and is never tampered with;
rows with the same doc_id ascend by digest (equal rows are equal leaves, in any order); a null source is a source of
its own, before the empty one; a lone leaf is its source's root, and of a lone source the root; without any sibling the
proof is the digest of nothing; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.common import spread_join, written

FANOUT = 3
#: Levels of a block's own subtree: 2,187 leaves.
LEVELS = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def framed(c: Column | str) -> Column:
    """Byte count and value, `-` for null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[framed(text if c == "text" else c) for c in FIELDS]), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """group (the source's name behind `s`, empty for null), doc_id, leaf, and as `tampered` the leaf of the text
    without line feeds where 2 divides the crc32 of doc_id (else null)."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(hit, leaf_of(F.replace("text", F.lit("\n"), F.lit(""))))
    return docs.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("leaf"), tampered.alias("tampered"))


def ranked(leaves: DataFrame, order: list[str], fanout: int, levels: int) -> DataFrame:
    """leaves (group, leaf, ...) with rank (from 0 within the group), size (of the group) and block.

    Range partitions are sorted and written with each row's place; what lies before a partition in its group comes from
    a table of one row per group and partition."""
    sorted_ = leaves.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    placed = written(sorted_.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33)), "manifest-places")
    parts = placed.groupBy("group", "__p").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before, whole = Window.partitionBy("group").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("group")
    parts = parts.select("group", "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("size"))
    out = placed.join(parts, ["group", "__p"]).withColumn("rank", F.col("__id") + F.col("__shift"))
    return out.withColumn("block", F.expr(f"rank div {fanout**levels}")).drop("__id", "__p", "__shift")


def climbed(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The levels of the tree over nodes: up to its root, or as many as given."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def block_roots(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """group, block, blocks (of the group) and node: the root of the block's subtree, from the rows of `ranked`."""

    def rooted(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        size = t["size"][0].as_py()
        top = climbed(t["leaf"].to_pylist(), fanout, levels if size > fanout**levels else None)[-1]
        head = t.slice(0, 1)
        return pa.table({"group": head["group"].cast(pa.string()), "block": head["block"], "blocks": pa.array([-(-size // fanout**levels)], pa.int64()), "node": pa.array(top, pa.string())})

    return rows.select("group", "block", "rank", "size", "leaf").groupBy("group", "block").applyInArrow(rooted, "group string, block long, blocks long, node string")


def swapped(state: DataFrame, step: int, fanout: int) -> DataFrame:
    """One round: the blocks whose numbers differ only in the digit worth `step` swap their nodes and hash them.

    The last group may lack blocks: then the others of its last subtree also send to those who would have had no
    partner (`to` runs over all places there are in a subtree). In groups that are one node already nothing changes."""
    group, active = F.expr(f"block div {step * fanout}"), F.col("blocks") > step
    members = F.least(F.lit(step), F.col("blocks") - F.expr(f"block div {step}") * step)  # of the block's subtree
    place, digit = F.col("block") % step, F.expr(f"(block div {step}) % {fanout}")
    to = F.explode(F.sequence(place, F.when(active & (digit > 0), F.lit(step - 1)).otherwise(place).cast("long"), members.cast("long")))
    sent = state.select("*", group.alias("__g"), digit.alias("__d"), place.alias("__own"), to.alias("__to"))
    run = F.array_sort(F.collect_list(F.struct(F.col("__d").alias("d"), F.col("node").alias("node"))).over(Window.partitionBy("group", "__g", "__to")))
    got = sent.withColumn("__run", run).where(F.col("__to") == F.col("__own"))
    nodes = lambda keep: F.array_join(F.transform(F.filter("__run", keep), lambda x: x["node"]), "")
    pair = F.struct(nodes(lambda x: x["d"] < F.col("__d")).alias("left"), nodes(lambda x: x["d"] > F.col("__d")).alias("right"))
    return got.select(
        "group", "block", "blocks", F.when(active, F.sha2(nodes(lambda x: F.lit(True)), 256)).otherwise(F.col("node")).alias("node"),
        F.when(active, F.concat("path", F.array(pair))).otherwise(F.col("path")).alias("path"),
    )


def exchanged(roots: DataFrame, fanout: int) -> DataFrame:
    """group, block, blocks, node (the group's root) and path: siblings left and right of the block's ancestors."""
    state = written(roots.withColumn("path", F.expr(f"cast(array() as {PATH})")), "manifest-blocks")
    most = state.agg(F.max("blocks")).first()[0] or 0
    step = 1
    while step < most:
        state = written(swapped(state, step, fanout), "manifest-round")
        step *= fanout
    return state


def local_paths(t: pa.Table, fanout: int, levels: int) -> list[list[tuple[str, str]]]:
    """Per leaf of a block (sorted by rank) its siblings, level by level, as left and right ones."""
    size = t["size"][0].as_py()
    tree = climbed(t["leaf"].to_pylist(), fanout, levels if size > fanout**levels else None)[:-1]
    paths = []
    for i in range(t.num_rows):
        path = []
        for level in tree:
            run = i - i % fanout
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
            i //= fanout
        paths.append(path)
    return paths


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def source_paths(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Per source: group, root (of all) and upper (its path), from the sources' roots."""
    subroots = blocks.where("block = 0").select(F.lit("").alias("group"), F.col("group").alias("source_group"), F.col("node").alias("leaf"))
    rows = written(ranked(subroots, ["source_group"], fanout, levels), "manifest-sources")
    tops = exchanged(block_roots(rows, fanout, levels), fanout)

    def joined(t: pa.Table, top: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        rest = [(x["left"], x["right"]) for x in top["path"][0].as_py()]
        paths = [[{"left": a, "right": b} for a, b in [*p, *rest]] for p in local_paths(t, fanout, levels)]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"group": t["source_group"].cast(pa.string()), "root": pa.array([top["node"][0].as_py()] * t.num_rows, pa.string()), "upper": pa.array(paths, kind)})

    return rows.groupBy("group", "block").cogroup(tops.groupBy("group", "block")).applyInArrow(joined, f"group string, root string, upper {PATH}")


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf, where there is one) and verified."""
    rows = written(ranked(written(leaves_of(docs), "manifest-leaves"), ["doc_id", "leaf"], fanout, levels), "manifest-ranks")
    blocks = exchanged(block_roots(rows, fanout, levels), fanout)
    sources = written(source_paths(blocks, fanout, levels), "manifest-tops")
    weighed = sources.join(blocks.where("block = 0").select("group", "blocks"), "group").withColumnRenamed("blocks", "__w")
    tops = spread_join(blocks, weighed, ["group"], "__w").select("group", "block", F.col("node").alias("subroot"), "root", F.concat("path", "upper").alias("path"))

    def proved(t: pa.Table, top: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        subroot, root = top["subroot"][0].as_py(), top["root"][0].as_py()
        rest = [(x["left"], x["right"]) for x in top["path"][0].as_py()]
        proofs, ends = [], []
        for leaf, other, path in zip(t["leaf"].to_pylist(), t["tampered"].to_pylist(), local_paths(t, fanout, levels), strict=True):
            path += rest
            proofs.append(digest(*[x for pair in path for x in pair]))
            ends.append(folded(leaf if other is None else other, path))
        n = t.num_rows
        return pa.table({
            "doc_id": t["doc_id"], "leaf": t["leaf"].cast(pa.string()), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(ends, pa.string()), "verified": pa.array([x == root for x in ends], pa.bool_()),
        })

    shape = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("group", "block").cogroup(tops.groupBy("group", "block")).applyInArrow(proved, shape)
