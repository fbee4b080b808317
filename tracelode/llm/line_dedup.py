"""Line dedup with a log-template tree (operator 1).

A line's tokens (split at white space; letters of scripts written without spaces are tokens each) lead through a tree of
fixed depth: the number of tokens, then the leading tokens without a digit, as far as there are any (tokens that hold a
digit are wildcards, so a date or number at the beginning doesn't lead all such lines to one leaf). In a leaf, lines join the template that most of their tokens agree with, if the share is at least
`similarity`; differing tokens become wildcards. A template with lines in two or more documents recurs: its lines stay
in the first such document (the smallest doc_id) and are dropped from all others. A template keeps at least one token that
isn't a wildcard; a line of which every token holds a digit (rows of a table of numbers) recurs only where an equal line does.

How it scales: the same masked line from many documents is one row before anything is gathered (partial aggregation
by its hash), lines of a hash that a great share of all lines have are dealt to several tasks when they meet their
template's first document, and what travels is hashes of lines and 16-bit hashes of tokens, not text (two unlike tokens in one place
agree by chance once in 65,535 times). A leaf's lines stream through one task sorted; its state is the templates and 20
bytes per different line. Where a leaf has over FEW templates, these are indexed by (place, token): as a line has to
agree with its template in all but d of n places, the template is in one of the lists of any d + 1 places, of which the
shortest are looked into. So the work doesn't grow with the square of a leaf; the templates found are the same.

Defined cases: lines of fewer than `least` tokens (op1 and the pipeline judge all from 1 token on), lines of white space,
null and empty texts stay as they are; rows with one doc_id are one document and are all kept; a null doc_id is a
document of its own before all others; an empty table gives none; very long lines are judged whole; a line that agrees
equally well with two templates joins the older one, and a leaf's lines come in order of their first document, then hash;
other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices, own_name, spread_join, written

DIGIT = re.compile(r"[0-9]")
#: Thai to Myanmar, Khmer, Tai scripts, Javanese, kana, bopomofo and Han with their punctuation: written without spaces.
UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3001-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff61-\uff9f\U00020000-\U0003ffff"
RUN = re.compile(f"[{UNSPACED}]")
PARTS = re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")
#: UTF-16 units that may be of such a letter: a text without any is split at white space.
MAYBE = np.array([RUN.match(chr(c)) is not None or 0xD840 <= c <= 0xDFFF for c in range(65536)])
#: What stands for a token with a digit or one in which lines differ; templates of a leaf that are compared one by one.
WILD, FEW = 0, 64
#: Begins a line that has no token without a digit: it is a leaf of its own.
ALONE = "\0\0"
LINES = "doc long, row long, line int, hash binary, leaf long, tokens binary"


def no_id() -> int:
    return -(2**63)


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """doc and row say which document and which text of it, whatever else docs holds."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(no_id())).alias("doc"), F.xxhash64(text).alias("row"), F.coalesce(text, F.lit("")).alias("text"))


def unspaced(text: str) -> bool:
    """Whether the text may hold letters of scripts written without spaces."""
    return not text.isascii() and bool(MAYBE[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")].any())


def tokens_of(line: str, unspaced: bool = True) -> list[str]:
    return PARTS.findall(line) if unspaced else line.split()


def small(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Masker:
    """Lines as hashes."""

    def __init__(self, depth: int, least: int):
        self.depth, self.least = depth, max(least, 1)

    def masked(self, line: str, unspaced: bool) -> bytes | None:
        """The tokens, NUL for those with a digit; where all have one, the line as it is behind two NULs, as only equal
        lines recur then. None for an empty line or one that is too short to judge."""
        tokens = tokens_of(line, unspaced)
        if len(tokens) < self.least:
            return None
        if not DIGIT.search(line):
            return " ".join(tokens).encode()
        masked = ["\0" if DIGIT.search(t) else t for t in tokens]
        return (" ".join(masked) if masked.count("\0") < len(masked) else ALONE + " ".join(tokens)).encode()

    def hash(self, masked: bytes) -> bytes:
        return hashlib.blake2b(masked, digest_size=16).digest()

    def leaf(self, masked: bytes) -> tuple[int, bytes]:
        """Its leaf and its tokens."""
        tokens = masked.split(b" ")
        if masked.startswith(ALONE.encode()):
            return small(masked), array("H", [crc32(t) % 65535 + 1 for t in tokens]).tobytes()
        leading = tokens[: self.depth] if b"\0" not in masked else islice((t for t in tokens if t != b"\0"), self.depth)
        leaf = small(b" ".join([b"%d" % len(tokens), *leading]))
        return leaf, array("H", [WILD if t == b"\0" else crc32(t) % 65535 + 1 for t in tokens]).tobytes()


def lines_of(docs: DataFrame, depth: int, least: int, tokens: bool, text: str = "text") -> DataFrame:
    """A row per line that is judged, with token hashes if asked for."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masker = Masker(depth, least)
        for batch, texts in in_slices(batches):
            rows: list[tuple] = []
            for doc, row, t in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), texts, strict=True):
                whole = unspaced(t)
                for k, line in enumerate(t.split("\n")):
                    if (m := masker.masked(line, whole)) is not None:
                        h = masker.hash(m)
                        rows.append((doc, row, k, h, *masker.leaf(m)) if tokens else (doc, row, k, h))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["doc", "row", "line", "hash", "leaf", "tokens"][: 6 if tokens else 4]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()][: len(names)]
    return keyed(docs, text).mapInArrow(split, LINES if tokens else "doc long, row long, line int, hash binary")


class Leaf:
    """The templates of one leaf."""

    def __init__(self, width: int, similarity: float):
        self.width = width
        self.least = math.ceil(similarity * width - 1e-9)  # places that have to agree
        self.templates = np.empty((1, width), np.uint16)
        self.low, self.high = [], []
        self.hashes, self.owner, self.lines = bytearray(), array("l"), array("q")
        self.lists: dict[int, list[int]] | None = None  # by place * 65,536 + token

    def add(self, h: bytes, low: int, high: int, lines: int, tokens: np.ndarray) -> None:
        n = len(self.low)
        best = self.best(tokens) if n else -1
        if best >= 0 and not ((self.templates[best] == tokens) & (tokens != WILD)).any():
            best = -1  # a template has to keep a token that isn't a wildcard
        if best < 0:
            best = n
            if n == len(self.templates):
                self.templates = np.concatenate([self.templates, np.empty((max(n, 3), self.width), np.uint16)])
            self.templates[n] = tokens
            self.low.append(low)
            self.high.append(high)
            if self.lists is not None:
                self.enter(n)
            elif n == FEW and self.least:
                self.lists = {}
                for i in range(n + 1):
                    self.enter(i)
        else:
            t = self.templates[best]
            for place in np.flatnonzero((t != tokens) & (t != WILD)).tolist():
                if self.lists is not None:
                    self.lists[place << 16 | int(t[place])].remove(best)
                    self.lists.setdefault(place << 16 | WILD, []).append(best)
                t[place] = WILD
            self.low[best], self.high[best] = min(self.low[best], low), max(self.high[best], high)
        self.hashes += h
        self.owner.append(best)
        self.lines.append(lines)

    def enter(self, i: int) -> None:
        for key in self.keys(self.templates[i]):
            self.lists.setdefault(key, []).append(i)

    def keys(self, tokens: np.ndarray) -> list[int]:
        return (np.arange(self.width, dtype=np.int64) << 16 | tokens).tolist()

    def best(self, tokens: np.ndarray) -> int:
        """The oldest of the templates that agree in most places, if these are enough; -1 if there is none."""
        if self.lists is None:
            share = np.count_nonzero(self.templates[: len(self.low)] == tokens, axis=1)
            at = int(share.argmax())
            return at if share[at] >= self.least else -1
        lists = sorted((self.lists.get(k, ()) for k in self.keys(tokens)), key=len)[: self.width - self.least + 1]
        looked = np.array(sorted(set(chain.from_iterable(lists))), np.int64)
        if not len(looked):
            return -1
        share = np.count_nonzero(self.templates[looked] == tokens, axis=1)
        at = int(share.argmax())
        return int(looked[at]) if share[at] >= self.least else -1

    def recurring(self) -> Iterator[tuple[bytes, int, int]]:
        """(hash, first document, number) of all lines of templates that recur."""
        for i, t in enumerate(self.owner):
            if self.high[t] > self.low[t]:
                yield bytes(self.hashes[16 * i : 16 * i + 16]), self.low[t], self.lines[i]


def recurring(docs: DataFrame, depth: int = 2, least: int = 3, similarity: float = 0.75, text: str = "text") -> DataFrame:
    """(hash, first, n) of the masked lines whose template recurs: each hash once, with how many lines have it."""
    distinct = lines_of(docs, depth, least, tokens=True, text=text).groupBy("leaf", "hash", "tokens").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
    ordered = distinct.repartition("leaf").sortWithinPartitions("leaf", F.length("tokens"), "low", "hash")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, at = None, None
        for batch in batches:
            for key, h, a, b, n, t in zip(*[batch.column(c).to_pylist() for c in ("leaf", "hash", "low", "high", "n", "tokens")], strict=True):
                if at != (key, len(t)):
                    if leaf is not None:
                        yield from found(leaf)
                    leaf, at = Leaf(len(t) // 2, similarity), (key, len(t))
                leaf.add(h, a, b, n, np.frombuffer(t, "<u2"))
        if leaf is not None:
            yield from found(leaf)

    def found(leaf: Leaf) -> Iterator[pa.RecordBatch]:
        rows = leaf.recurring()
        while some := list(islice(rows, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["hash", "first", "n"])

    return ordered.mapInArrow(parse, "hash binary, first long, n long")


def marked(docs: DataFrame, depth: int = 2, least: int = 3, similarity: float = 0.75, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, and its name: places of the lines to drop, null if none. All lines are judged."""
    found = written(recurring(docs, depth, least, similarity, text), "recurring-lines")
    lines = lines_of(docs, depth, least, tokens=False, text=text)
    key, drop = own_name(docs, "__key"), own_name(docs, "__drop")
    drops = spread_join(lines, found, ["hash"], "n").where("doc <> first").groupBy("doc", "row").agg(F.collect_set("line").alias(drop))
    left = docs.withColumn(key, F.struct(F.coalesce(F.col("doc_id"), F.lit(no_id())).alias("doc"), F.xxhash64(text).alias("row")))
    return left.join(drops.select(F.struct("doc", "row").alias(key), drop), key, "left").drop(key), drop


def kept_text(drop: str, text: str = "text"):
    """The text without the lines of the column drop."""
    lines = F.split(F.col(text), "\n", -1)
    rest = F.filter(lines, lambda x, i: ~F.array_contains(drop, i))
    return F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))


def deduplicated(docs: DataFrame, text: str = "text", **tree) -> DataFrame:
    """docs without lines that recur; documents that lose every line go, all columns stay."""
    found, drop = marked(docs, text=text, **tree)
    found = found.withColumn(text, kept_text(drop, text))
    return found.where(F.col(drop).isNull() | (F.length(text) > 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, text: str = "text", **tree) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped and the text that is left."""
    found, drop = marked(docs.select("doc_id", F.col(text).alias("text")), **tree)
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return found.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"), kept_text(drop).alias("text"))
