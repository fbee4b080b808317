"""Benchmark decontamination by a generalised suffix automaton of the test items (operator 10).

The items' words, lower-cased, make a suffix automaton. Training words are streamed through it: after each word the
state and length say the longest stretch, ending there, that some item contains. Where it has `window` words, the last
`window` of them are hit; items shorter than that hit where they occur whole.

The automaton is built in shards of about SHARD_CHARS of item text, each by a task of its own and a file in the shared
folder. Workers load one at a time (the one before goes first) and take a large part of their input through it: the
driver never holds the benchmark, a worker never more than one shard, which takes about 100 MB.

Defined cases: null and empty texts have no words and hit nothing; items without words are none; items that repeat an
item_id count once, a null item_id counts as ''; rows that repeat and null doc_ids stay; an empty benchmark hits nothing
and an empty table gives no rows; windows that several items share name them all; other columns aren't read by
contamination() and are kept by cleaned(). Texts are streamed whole, however long.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices, scratch, texts_of
from tracelode.llm.token_output import filesystem

SHARD_CHARS = 4_000_000
#: Bytes of input that a task takes through one automaton before it loads the next, where there are several.
ROUND = 64_000_000
#: A word before A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: ASCII capitals to small letters, all else in ASCII that isn't a letter or digit to blanks.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class SuffixAutomaton:
    """Of several word sequences, in arrays: a state's first transition (word and target), its link and the length of its
    longest stretch; only states with several transitions, few of all, have a dictionary of the others. About 30 bytes a
    state, of which there are at most two per word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        ends = []
        for _, words in items:
            last, states = 0, array("i")
            for w in words:
                last = self.extend(last, self.ids.setdefault(w, len(self.ids)))
                states.append(last)
            ends.append(states)
        self.name([n for n, _ in items], ends)

    def step(self, p: int, c: int) -> int:
        """The state after word c, or -1."""
        if self.word[p] == c:
            return self.to[p]
        others = self.more.get(p)
        return others.get(c, -1) if others else -1

    def lead(self, p: int, c: int, q: int) -> None:
        if self.word[p] in (-1, c):
            self.word[p], self.to[p] = c, q
        else:
            self.more.setdefault(p, {})[c] = q

    def extend(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        if (q := self.step(last, c)) >= 0:
            return q if length[q] == length[last] + 1 else self.clone(last, c, q)
        cur = self.state(-1, -1, 0, length[last] + 1)
        p = last
        while p >= 0 and (q := self.step(p, c)) < 0:
            self.lead(p, c, cur)
            p = link[p]
        if p >= 0:
            link[cur] = q if length[q] == length[p] + 1 else self.clone(p, c, q)
        return cur

    def clone(self, p: int, c: int, q: int) -> int:
        new = self.state(self.word[q], self.to[q], self.link[q], self.length[p] + 1)
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self.step(p, c) == q:
            self.lead(p, c, new)
            p = self.link[p]
        return new

    def state(self, word: int, to: int, link: int, length: int) -> int:
        self.word.append(word)
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def name(self, names: list[str], ends: list[array]) -> None:
        """Which items' windows end in a state: those of `window` words, and whole shorter items by their length. States
        hold the numbers of different sets of names, -1 for none."""
        number = {n: i for i, n in enumerate(dict.fromkeys(names))}
        states, owners, short = array("i"), array("i"), {}
        for name, own in zip(names, ends, strict=True):
            if 0 < len(own) < self.window:
                short.setdefault(self.holder(own[-1], len(own)), set()).add((len(own), name))
            for s in own[self.window - 1 :]:
                states.append(self.holder(s, self.window))
                owners.append(number[name])
        self.sets, known = [(n,) for n in number], {}
        self.windows = array("i", [-1]) * len(self.link)
        pairs = np.unique(np.frombuffer(states, np.int32).astype(np.int64) << 32 | np.frombuffer(owners, np.int32)) if states else np.empty(0, np.int64)
        begins = np.append(np.flatnonzero(np.diff(pairs >> 32, prepend=-1)), len(pairs)).tolist()
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            own = (pairs[a:b] & 0xFFFFFFFF).tolist()
            if len(own) > 1:
                key = tuple(own)
                if key not in known:
                    known[key] = len(self.sets)
                    self.sets.append(tuple(sorted(self.sets[i][0] for i in own)))
                own = [known[key]]
            self.windows[int(pairs[a] >> 32)] = own[0]
        self.short, self.shorts = array("i", [-1]) * len(self.link), []
        if short:
            combined: dict[tuple[int, tuple], int] = {}
            for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist():  # links lead to shorter ones
                up = self.short[self.link[s]] if s else -1
                if s in short:
                    key = up, tuple(sorted(short[s]))
                    if key not in combined:
                        combined[key] = len(self.shorts)
                        self.shorts.append((*(self.shorts[up] if up >= 0 else ()), *key[1]))
                    up = combined[key]
                self.short[s] = up

    def holder(self, state: int, n: int) -> int:
        """The state of the last n words of a stretch that ends in state."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of word places that are hit, joined where they touch, and the items hit."""
        first, to, more, link, length, window, short = self.word, self.to, self.more, self.link, self.length, self.window, self.short
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        state = n = 0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                state = n = 0
                continue
            while True:
                if first[state] == w:
                    after = to[state]
                    break
                others = more.get(state)
                after = others.get(w, -1) if others else -1
                if after >= 0 or not state:
                    break
                state = link[state]
                n = length[state]
            if after < 0:
                continue
            state = after
            n += 1
            if n >= window:
                add(spans, i + 1 - window, i + 1)
                names.update(self.sets[self.windows[self.holder(state, window)]])
            if short[state] >= 0:
                for m, name in self.shorts[short[state]]:
                    if m <= n:
                        add(spans, i + 1 - m, i + 1)
                        names.add(name)
        return spans, names


def add(spans: list[tuple[int, int]], a: int, b: int) -> None:
    while spans and spans[-1][1] >= a:
        a, b = min(a, spans[-1][0]), max(b, spans.pop()[1])
    spans.append((a, b))


def build(benchmark: DataFrame, window: int, shard_chars: int = SHARD_CHARS) -> list[str]:
    """Writes the automata of the benchmark (item_id, text) to the shared folder, a shard at a time."""
    spark = benchmark.sparkSession
    items = texts_of(benchmark, F.col("item_id").cast("string").alias("item_id"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_chars))
    out = scratch(spark, "automata")

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[str, list[bytes]]]] = {}
        for batch in batches:
            for shard, item, text in zip(*[batch.column(c).to_pylist() for c in ("shard", "item_id", "text")], strict=True):
                if words := words_of(text):
                    held.setdefault(shard, []).append((item or "", words))
        for shard, rows in held.items():
            fs, base = filesystem(out)
            fs.create_dir(base, recursive=True)
            name = f"{shard}-{uuid.uuid4().hex}.pickle"  # a task that runs again leaves its first file unused
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(pickle.dumps(SuffixAutomaton(sorted(rows), window)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{out}/{name}"])], ["path"])

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    return sorted(r.path for r in dealt.mapInArrow(built, "path string").collect())  # a path per shard


def grouped(batches: Iterator[pa.RecordBatch], text: str, paths: list[str]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a task's input: with several automata as large as ROUND, since each slice loads them all in turn."""
    if len(paths) < 2:
        yield from in_slices(batches, text)
        return
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= ROUND:
            yield from in_slices([pa.concat_batches(held)], text, ROUND)
            held, size = [], 0
    if held:
        yield from in_slices([pa.concat_batches(held)], text, ROUND)


#: The one automaton that a worker holds.
LOADED: dict[str, SuffixAutomaton] = {}


def load(path: str) -> SuffixAutomaton:
    """The automaton of a file; the one before it goes first."""
    if path not in LOADED:
        LOADED.clear()
        fs, base = filesystem(path)
        with fs.open_input_stream(base) as f:
            LOADED[path] = pickle.loads(f.read())
    return LOADED[path]


def all_hits(paths: list[str], texts: list[str]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: number of words, hit spans, items; shard after shard."""
    split = [words_of(t) for t in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    names: list[set[str]] = [set() for _ in texts]
    for path in paths:
        automaton = load(path)
        for i, words in enumerate(split):
            found, items = automaton.hits(words)
            if found:
                names[i] |= items
                merged: list[tuple[int, int]] = []
                for a, b in sorted(spans[i] + found):
                    add(merged, a, b)
                spans[i] = merged
    return [(len(w), s, n) for w, s, n in zip(split, spans, names, strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. No shuffle."""
    paths = build(benchmark, window)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grouped(batches, text, paths):
            found = all_hits(paths, texts)
            hit = [sum(b - a for a, b in s) for _, s, _ in found]
            columns = [
                batch.column("doc_id").cast(pa.int64()), pa.array([n for n, _, _ in found], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for _, _, x in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for _, _, x in found]), pa.array([h > 0 for h in hit]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return texts_of(docs, "doc_id", text=text).mapInArrow(judge, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_hits(texts: list[str], paths: list[str], coverage: float) -> list[str | None]:
    """The texts without their hit spans; None for those of which these are more than the share `coverage` of the words.
    What the removal brings together is looked through again, all texts at once, until nothing is hit."""
    out: list[str | None] = list(texts)
    total: dict[int, int] = {}
    open_ = list(range(len(texts)))
    while open_:
        still = []
        for i, (n, spans, _) in zip(open_, all_hits(paths, [out[i] or "" for i in open_]), strict=True):
            if spans:
                kept = n - sum(b - a for a, b in spans)
                if kept < (1 - coverage) * total.setdefault(i, n):
                    out[i] = None
                else:
                    out[i] = cut_out(out[i] or "", spans)
                    still.append(i)
        open_ = still
    return out


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5, text: str = "text") -> DataFrame:
    """docs with hit spans removed from their texts, without the documents that are hit beyond `coverage`; all columns stay."""
    paths = build(benchmark, window)
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grouped(batches, text, paths):
            at = batch.schema.get_field_index(text)
            found = all_hits(paths, texts)
            if hit := [i for i, (_, spans, _) in enumerate(found) if spans]:
                new = batch.column(at).to_pylist()
                keep = [True] * len(new)
                for i, t in zip(hit, without_hits([texts[i] for i in hit], paths, coverage), strict=True):
                    new[i], keep[i] = t, t is not None
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.column(at).type)).filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(clean, schema)
