"""Secret scans by grammar inference (operator 5).

Base spans come from three patterns. Their values are the labelled credentials: per kind, a prefix tree of the values
is generalised by merging states whose outcome frequencies are statistically compatible (Hoeffding's bound, red-blue
order) into a probabilistic automaton. Every other run of credential characters, from the length of the shortest
labelled value on, is then scored with all automata against a model of ordinary runs; what a format makes clearly
likelier, per character, is added as a `learned` span. Of runs that base spans touch, the parts outside are scored.

Defined cases: null and empty texts have no spans; a corpus without credentials or ordinary runs adds nothing; an empty
table gives no rows; repeated rows and null doc_ids stay; other columns aren't read. Texts are scanned whole in time that
grows with their length, offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices, texts_of, written

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: One of these is in any text that ASSIGN matches, lower-cased.
WORDS = (b"passw", b"secret", b"token", b"api")


def marks(chars: str) -> bytes:
    """A table for bytes.translate: x for the ASCII characters of a class, a blank for all else."""
    return bytes(ord("x") if re.match(f"[{chars}]", chr(b), re.A) else ord(" ") for b in range(256))


HEX = marks("0-9a-f")
#: Runs that can be credentials: as long as the shortest labelled value, with dots only inside.
LEAST = 6
RUN = re.compile(r"[0-9A-Za-z+/_=-]+(?:\.+[0-9A-Za-z+/_=-]+)*", re.A)
#: Bounds of what is learned from: distinct values per kind, ordinary runs (the smallest by hash), and the symbols of
#: each kind's values together, so that an automaton's tree has a bounded number of states. A value of over LONGEST
#: characters isn't learned from; it is found and scored as any other.
TRAIN_VALUES, TRAIN_RUNS, TRAIN_SYMBOLS, LONGEST = 2000, 4000, 200_000, 4096
#: A span is learned if a format is likelier than ordinary text by this much (natural logarithm) per character, beyond
#: the odds of ordinary runs against labelled values in the corpus.
MARGIN = 0.35
#: Scores of distinct runs that a worker keeps.
KEPT = 300_000


def long_runs(raw: bytes, table: bytes, least: int) -> list[tuple[int, int]]:
    """Byte spans of the maximal runs of at least `least` characters that table keeps."""
    marked, want = raw.translate(table), b"x" * least
    out, at = [], 0
    while (at := marked.find(want, at)) >= 0:
        end = marked.find(b" ", at)
        end = len(marked) if end < 0 else end
        out.append((at, end))
        at = end
    return out


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) of the three patterns, leftmost without overlap within a kind."""
    found = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    at = start = 0
    for a, b in long_runs(raw, HEX, 24):
        start += len(raw[at:a].decode())  # code points from the last run on, so that each byte is read once
        found.append((start, 2, start + b - a, raw[a:b].decode()))
        start, at = start + b - a, b
    return sorted(found)


def free_runs(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Runs of credential characters, in code points, and of those that base spans touch the parts outside them.
    spans are sorted: both lists are walked once."""
    at, taken = 0, [(s, e) for s, _, e, _ in spans]
    for m in RUN.finditer(text):
        start, end = m.span()
        if end - start < LEAST:
            continue
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        k = at
        while k < len(taken) and taken[k][0] < end:
            if taken[k][0] - start >= LEAST:
                yield start, taken[k][0], text[start : taken[k][0]]
            start = max(start, taken[k][1])
            k += 1
        if end - start >= LEAST:
            yield start, end, text[start:end]


def symbols(value: str) -> list[str]:
    """The characters as the automata read them: the first four as they are, later ones by class."""
    return [c if i < 4 else "d" if c.isdigit() else "h" if c in "abcdef" else "l" if c.islower() else "H" if c in "ABCDEF" else "u" if c.isupper() else c for i, c in enumerate(value)]


class Automaton:
    """A probabilistic automaton, merged from the prefix tree of symbol sequences (ALERGIA, red-blue order)."""

    def __init__(self, sequences: Iterable[list[str]], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[defaultdict] = [defaultdict(int)]  # how often a symbol follows
        self.ends, self.visits = [0], [0]
        for s in sequences:
            at = 0
            self.visits[0] += 1
            for x in s:
                self.seen[at][x] += 1
                if x not in self.next[at]:
                    self.next[at][x] = len(self.next)
                    self.next.append({})
                    self.seen.append(defaultdict(int))
                    self.ends.append(0)
                    self.visits.append(0)
                at = self.next[at][x]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.merge()
        self.alphabet = len({x for row in self.seen for x in row}) + 1

    def differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if not n or not m:
                continue
            if self.differ(self.ends[a], n, self.ends[b], m):
                return False
            for x in {*self.seen[a], *self.seen[b]}:
                if self.differ(self.seen[a].get(x, 0), n, self.seen[b].get(x, 0), m):
                    return False
                if x in self.next[a] and x in self.next[b]:
                    todo.append((self.next[a][x], self.next[b][x]))
        return True

    def fold(self, red: int, blue: int) -> None:
        """Adds the tree below blue to red's automaton."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for x, n in self.seen[b].items():
                self.seen[a][x] += n
            for x, child in self.next[b].items():
                if x in self.next[a]:
                    todo.append((self.next[a][x], child))
                else:
                    self.next[a][x] = child

    def merge(self) -> None:
        """Every blue state joins the first red one that is compatible, or becomes red itself."""
        red = [0]
        known = {0}
        blue = [(0, x, c) for x, c in sorted(self.next[0].items())]
        while blue:
            parent, x, state = blue.pop(0)
            if self.next[parent].get(x) != state or state in known:
                continue
            for r in red:
                if self.compatible(r, state):
                    self.next[parent][x] = r
                    self.fold(r, state)
                    blue = [(p, y, c) for p in red for y, c in sorted(self.next[p].items()) if c not in known]
                    break
            else:
                red.append(state)
                known.add(state)
                blue += [(state, y, c) for y, c in sorted(self.next[state].items()) if c not in known]

    def log_likelihood(self, s: list[str]) -> float:
        """Of a sequence and its end, with a little probability left for what was never seen."""
        at: int | None = 0
        total = 0.0
        for x in s:
            if at is None:
                total -= math.log(2 * self.alphabet)
                continue
            total += math.log((self.seen[at].get(x, 0) + 0.1) / (self.visits[at] + 0.1 * self.alphabet))
            at = self.next[at].get(x)
        return total + (math.log((self.ends[at] + 0.1) / (self.visits[at] + 0.1 * self.alphabet)) if at is not None else -math.log(2 * self.alphabet))


class Ordinary:
    """How symbols follow each other in ordinary runs: bigram frequencies."""

    def __init__(self, sequences: Iterable[list[str]]):
        self.pairs: defaultdict = defaultdict(int)
        self.ones: defaultdict = defaultdict(int)
        for s in sequences:
            for a, b in zip(["^", *s], [*s, "$"], strict=True):
                self.pairs[a, b] += 1
                self.ones[a] += 1

    def log_likelihood(self, s: list[str]) -> float:
        return sum(math.log((self.pairs.get((a, b), 0) + 0.1) / (self.ones.get(a, 0) + 8)) for a, b in zip(["^", *s], [*s, "$"], strict=True))


SIZES = dict.fromkeys(KINDS[:3], TRAIN_VALUES) | {"ordinary": TRAIN_RUNS}


class Smallest:
    """The distinct values with the smallest hashes seen so far, by kind, and how often each kind was seen."""

    def __init__(self) -> None:
        self.values: dict[str, dict[str, int]] = {k: {} for k in SIZES}
        self.limit = dict.fromkeys(SIZES, 1 << 64)
        self.count = dict.fromkeys(SIZES, 0)

    def add(self, kind: str, value: str) -> None:
        self.count[kind] += 1
        known = self.values[kind]
        if len(value) <= LONGEST and value not in known and (h := xxhash.xxh64_intdigest(value)) < self.limit[kind]:
            known[value] = h
            if len(known) >= 2 * SIZES[kind]:
                kept = sorted(known.items(), key=lambda x: (x[1], x[0]))[: SIZES[kind]]
                self.values[kind], self.limit[kind] = dict(kept), kept[-1][1] + 1


def training_values(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value, hash, n): base values by kind and free runs as kind 'ordinary', of each task those with the smallest
    hashes, which are enough for the smallest of all; and with a null value how many there were."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Smallest()
        for _, texts in in_slices(batches, text):
            for t in texts:
                spans = base_spans(t, t.encode())
                for _, k, _, v in spans:
                    seen.add(KINDS[k], v)
                for _, _, v in free_runs(t, spans):
                    seen.add("ordinary", v)
        rows = [(k, v, h - (1 << 63), 0) for k, own in seen.values.items() for v, h in own.items()] + [(k, None, 0, n) for k, n in seen.count.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["kind", "value", "hash", "n"])

    return texts_of(docs, text=text).mapInArrow(values, "kind string, value string, hash long, n long")


class Formats:
    """What was learned: automata by kind, the ordinary model, and the logarithm of the odds of ordinary runs."""

    def __init__(self, automata: dict[str, Automaton], ordinary: Ordinary, odds: float):
        self.automata, self.ordinary, self.odds = automata, ordinary, odds
        self.known: dict[str, bool] = {}

    def held(self, value: str) -> bool:
        """Whether a format is clearly likelier; answers for KEPT short values are kept."""
        answer = self.known.get(value)
        if answer is None:
            answer = self.score(value)[0] > MARGIN
            if len(value) <= 64:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[value] = answer
        return answer

    def score(self, value: str) -> tuple[float, str]:
        """By how much, per character, the likeliest format beats ordinary text beyond the odds; and that format. Of
        formats that are equally likely, the last by name."""
        s = symbols(value)
        base = self.ordinary.log_likelihood(s) + self.odds
        return max(((a.log_likelihood(s) - base) / len(s), k) for k, a in self.automata.items()) if self.automata else (-math.inf, "")


def learn(docs: DataFrame, text: str = "text") -> Formats:
    """From the smallest values by hash: the same ones at every partitioning. One scan of the texts, written once."""
    table = written(training_values(docs, text), "values")
    count = {r.kind: r.n for r in table.where("value is null").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    picked: dict[str, list[str]] = {}
    for kind, n in SIZES.items():
        rows = table.where(F.col("kind") == kind).groupBy("value").agg(F.min("hash").alias("hash")).where("value is not null").orderBy("hash", "value").limit(n).collect()
        left, picked[kind] = TRAIN_SYMBOLS, []
        for r in rows:
            if len(r.value) <= left:
                picked[kind].append(r.value)
                left -= len(r.value)
    automata = {k: Automaton(map(symbols, sorted(v))) for k, v in picked.items() if k != "ordinary" and v}
    labelled = sum(count.get(k, 0) for k in KINDS[:3])
    return Formats(automata, Ordinary(map(symbols, sorted(picked["ordinary"]))), math.log(max(1.0, count.get("ordinary", 0) / max(labelled, 1))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, the numbers of base spans, base_sha256, all spans, and the number of learned ones."""
    formats = learn(docs, text)

    def row(doc_id: int | None, t: str) -> tuple:
        raw = t.encode()
        spans = base_spans(t, raw)
        more = [(s, 3, e, v) for s, e, v in free_runs(t, spans) if formats.held(v)]
        n = [sum(x[1] == k for x in spans) for k in range(3)]
        return doc_id, *n, hashlib.sha256(listed(spans).encode()).hexdigest(), listed(sorted(spans + more)), len(more)

    def listed(spans: list[tuple[int, int, int, str]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches, text):
            rows = [row(*x) for x in zip(batch.column("doc_id").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    return texts_of(docs, "doc_id", text=text).mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")
