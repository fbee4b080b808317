"""Phrases whose words belong together, per language, from counts of the longest windows alone.

Every word opens one window: itself and the words that lead it, ORDER at most, padded (null) behind the end of its piece. Only these
windows are counted; ROLLUP over their words then sums successively shorter prefixes, which are the counts of all
shorter phrases, of words and of the language. Phrases of two, three and four words aren't exploded.

Before that, one pass counts adjacent pairs and triples by a 32-bit hash: a window is padded from its first pair or
triple on that occurs less than `least` times, as no phrase across it can be a candidate. What passes is a bitmap of
BITS bits, the only thing broadcast; where hashes meet, windows stay longer than they need to be, and the counts are the
same. So what is shuffled grows with the words, and only windows that begin frequently travel whole. Windows of fewer
than `least` occurrences lose their last word before the prefixes are summed, and prefixes below `least` are dropped, as
every part of a candidate is at least as frequent as the candidate.

Tasks count what they have read in parts of at most FLUSH words before anything is shuffled, so a pair or word with a
third of all places is one row per part and task. Ranks come from a table of at most `top` rows of each of BUCKETS
buckets of a language.

Cases: a null text is empty, a null language `und` (with a language of that name); an empty table, texts without words
or fewer than `least` places give no rows; repeated rows count each; phrases of the same score and count ascend
bytewise; other columns aren't read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices, written

ORDER, RUNS = 4, (2, 3)
NAMES = [f"w{i + 1}" for i in range(ORDER)]
#: What ends a piece, and what stands between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t "
FLAT = bytes.maketrans(string.ascii_uppercase.encode() + ENDS + BLANKS, string.ascii_lowercase.encode() + b"\n" * len(ENDS) + b" " * len(BLANKS))
#: Words counted at once by a task, distinct words it keeps, bits of the bitmap, buckets of a language's ranks.
FLUSH, KEPT, BITS, BUCKETS = 1 << 19, 1 << 18, 1 << 26, 64
#: Bytes of text that become words at once.
SLICE = 1 << 20
GAP, NOTHING = 0, -1


class Codes(dict):
    """Numbers of a language's words (as UTF-8), from a list shared by all languages of a task."""

    def __init__(self, lang: str, words: list, langs: list, hashes: list):
        super().__init__({b"": NOTHING, b"\n": GAP})
        self.lang, self.head, self.words, self.langs, self.hashes = lang, f"{lang}\n".encode(), words, langs, hashes

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        self.hashes.append(xxhash.xxh64_intdigest(self.head + word))
        return code


class Lexicon:
    """The words of a task so far; code 0 is a gap."""

    def __init__(self):
        self.words, self.langs, self.hashes, self.by = [None], [None], [0], {}

    def codes(self, lang: str, texts: list[str]) -> np.ndarray:
        """The texts' words as numbers, with gaps between pieces and at the end."""
        by = self.by.setdefault(lang, Codes(lang, self.words, self.langs, self.hashes))
        data, parts, begin = "\n".join(texts).encode().translate(FLAT).replace(b"\n", b" \n "), [], 0
        while begin >= 0:
            end = data.find(b" ", begin + SLICE)  # a long text's words, some at a time
            tokens = data[begin : None if end < 0 else end].split(b" ")
            codes = np.fromiter(map(by.__getitem__, tokens), np.int64, len(tokens))
            parts.append(codes[codes != NOTHING])
            begin = end
        return np.concatenate([*parts, [GAP] * ORDER])


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lexicon, np.ndarray]]:
    """Numbers of the words of about FLUSH places at a time, with the lexicon that they refer to. What is yielded ends
    with the ORDER - 1 words that lead its last place, or with gaps."""
    lexicon, held, size = Lexicon(), [], 0

    def parts() -> Iterator[tuple[Lexicon, np.ndarray]]:
        whole = np.concatenate(held)
        for i in range(0, len(whole) - ORDER + 1, FLUSH):
            yield lexicon, whole[i : i + FLUSH + ORDER - 1]

    for part, texts in in_slices(batches, chars=SLICE):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(part.column(part.schema.get_field_index("lang")).to_pylist(), texts, strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, some in by_lang.items():
            held.append(lexicon.codes(lang, some))
            size += len(held[-1])
        if size >= FLUSH:
            yield from parts()
            held, size = [], 0
            if len(lexicon.words) > KEPT:
                lexicon = Lexicon()
    if held:
        yield from parts()


def leads(codes: np.ndarray) -> list[np.ndarray]:
    """ORDER columns: each place that isn't a gap, and what leads it until the next gap (gaps from there on)."""
    n = max(0, len(codes) - ORDER + 1)
    columns = [codes[i : n + i] for i in range(ORDER)]
    words = columns[0] != GAP
    columns = [c[words] for c in columns]
    for i in range(2, ORDER):
        columns[i] = np.where(columns[i - 1] == GAP, GAP, columns[i])
    return columns


def run_hashes(lexicon: Lexicon, columns: list[np.ndarray]) -> np.ndarray:
    """32-bit hashes of runs of words, one after the other; the language is in each word's hash."""
    hashes = np.array(lexicon.hashes, np.uint64)
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed = (mixed ^ hashes[c]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64)


def frequent_runs(texts: DataFrame, least: int) -> bytes:
    """A bit for the hash (modulo BITS) of each pair and triple that has at least so many places."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lexicon, codes in sequences(batches):
            columns = leads(codes)
            for k in RUNS:
                there = columns[k - 1] != GAP
                found, n = np.unique(run_hashes(lexicon, [c[there] for c in columns[:k]]), return_counts=True)
                yield pa.record_batch({"run": found, "n": n.astype(np.int64)})

    runs = texts.mapInArrow(counted, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bit = F.pmod("run", F.lit(BITS)) + 1
    rows = runs.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # BITS / 8 bytes
    out = bytearray(BITS // 8)
    for r in rows:
        begin = (r["bucket"] - 1) * len(r["bits"])
        out[begin : begin + len(r["bits"])] = r["bits"]
    return bytes(out)


def tallied(lexicon: Lexicon, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The different windows with their counts: pairs of words are numbered, then pairs of those."""
    shift, mask = np.int64(31), (1 << 31) - 1
    heads, first = np.unique(columns[0] << shift | columns[1], return_inverse=True)
    tails, then = np.unique(columns[2] << shift | columns[3], return_inverse=True)
    keys, n = np.unique(first << shift | then, return_counts=True)
    words, langs = pa.array(lexicon.words, pa.binary()), pa.array(lexicon.langs, pa.string())
    for i in range(0, len(keys), 50_000):
        own = keys[i : i + 50_000]
        h, t = heads[own >> shift], tails[own & mask]
        codes = [h >> shift, h & mask, t >> shift, t & mask]
        yield pa.record_batch({"lang": langs.take(pa.array(codes[0])), **{w: words.take(pa.array(c)).cast(pa.string()) for w, c in zip(NAMES, codes, strict=True)}, "n": n[i : i + 50_000].astype(np.int64)})


def windows(texts: DataFrame, least: int) -> DataFrame:
    """lang, w1 to w4 (null from the end of the piece, or from a run that is too rare), n: per part of a task."""
    bits = texts.sparkSession.sparkContext.broadcast(frequent_runs(texts, least))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        for lexicon, codes in sequences(batches):
            columns = [c.copy() for c in leads(codes)]
            for k in RUNS:
                for i in range(k - 1, ORDER):  # the run that ends with word i
                    there = np.flatnonzero(columns[i] != GAP)
                    bit = run_hashes(lexicon, [c[there] for c in columns[i - k + 1 : i + 1]]) % BITS
                    rare = there[(known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 0]
                    for later in columns[i:]:
                        later[rare] = GAP
            yield from tallied(lexicon, columns)

    return texts.mapInArrow(counted, f"lang string, {', '.join(f'{w} string' for w in NAMES)}, n long")


def counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, size (words of the phrase, 0 for all words of the language), phrase and f, of at least `least` places."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    whole = windows(texts, least).groupBy("lang", *NAMES).agg(F.sum("n").alias("n"))
    whole = whole.withColumn(NAMES[-1], F.when(F.col("n") >= least, F.col(NAMES[-1])))
    summed = whole.rollup("lang", *NAMES).agg(F.sum("n").alias("f"), F.grouping_id().alias("__gid"))
    size = reduce(lambda out, k: out.when(F.col("__gid") == (1 << (ORDER - k)) - 1, F.lit(k)), range(ORDER + 1), F.when(F.lit(False), 0))
    last = reduce(lambda out, k: out.when(F.col("size") == k, F.col(NAMES[k - 1])), range(1, ORDER + 1), F.when(F.lit(False), ""))
    sized = summed.withColumn("size", size).where("size is not null").where((F.col("size") == 0) | (last.isNotNull() & (F.col("f") >= least)))
    return sized.select("lang", "size", F.concat_ws(" ", *NAMES).alias("phrase"), "f")


def exact(c: str) -> Column:
    """Wide enough for products of counts."""
    return F.col(c).cast("decimal(20,0)")


def cut(phrases: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of the lowest-scoring cut."""
    candidates = phrases.where("size >= 2").withColumnRenamed("f", "a")
    opened = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    parts = opened.select("lang", "phrase", "size", "a", F.explode(F.array(
        F.struct("k", F.lit(True).alias("left"), F.col("first").alias("part")), F.struct("k", F.lit(False).alias("left"), F.expr("substring(phrase, length(first) + 2)").alias("part")),
    )).alias("__c")).select("lang", "phrase", "size", "a", "__c.*")
    known = parts.join(phrases.where("size between 1 and 3").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = {f"{s}{k}": F.max(F.when((F.col("k") == k) & (F.col("left") == (s == "l")), F.col("f"))) for k in range(1, ORDER) for s in "lr"}
    found = known.groupBy("lang", "phrase", "size", "a").agg(*[c.alias(n) for n, c in sides.items()])
    score = lambda k: F.expr(f"cast(a as decimal(20,0)) * 2000000 div (cast(l{k} as decimal(20,0)) + r{k})")
    cuts = [F.when(F.col("size") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, ORDER)]
    return found.select("lang", "phrase", "size", "a", F.array_min(F.array(*cuts)).alias("__m")).select("lang", "phrase", "size", "a", "__m.l", "__m.r", "__m.score")


def inner(phrases: DataFrame) -> DataFrame:
    """lang, phrase and most: the largest count of a longer candidate that has the phrase inside."""
    spans = [(k, i, j) for k in range(3, ORDER + 1) for j in range(2, k) for i in range(1, k - j + 2)]  # size, place, words
    inside = lambda i, j: F.array_join(F.slice(F.split("phrase", " "), i, j), " ")
    subs = F.filter(F.array(*[F.when(F.col("size") == k, inside(i, j)) for k, i, j in spans]), lambda x: x.isNotNull())
    return phrases.where("size >= 3").select("lang", F.explode(subs).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mined(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases."""
    phrases = written(counts(docs, least), "phrases")
    kept = cut(phrases).join(inner(phrases), ["lang", "phrase"], "left").where(F.col("most").isNull() | (exact("most") * 100 < exact("a") * cover))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("__b", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).withColumn("__r", F.row_number().over(Window.partitionBy("lang", "__b").orderBy(*order))).where(F.col("__r") <= top)
    ranks = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # of BUCKETS * top rows
    total = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranks.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
