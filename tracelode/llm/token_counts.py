"""Token counts by heap-and-linked-list byte-pair merging (operator 9): no identifiers are emitted.

The symbols of a pre-token stand in a linked list; a heap holds its adjacent pairs by merge rank, then place. The
lowest is popped and merged again and again; the count is the initial symbols minus the merges. Each distinct
chunk of text is merged once per worker and its count kept (see tokens.Chunks).

Defined cases: a null text is an empty one with 0 tokens; repeated rows and null doc_ids stay; an empty table gives no
rows; of two pairs with the same rank the left one is merged first; other columns aren't read. Special
strings inside a text count one token each, as is the tokenizers library's default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tracelode.llm.common import in_slices, texts_of
from tracelode.llm.tokens import SPACE, Chunks, as_chars

#: Fixed value: the split that a byte-level pre-tokenizer with use_regex makes.
BYTE_LEVEL = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapify(heap)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    merges = 0
    while heap:
        rank, i = heappop(heap)
        a, j = symbols[i], right[i]
        if not a or j >= n or ranks.get((a, symbols[j])) != rank:
            continue  # one of the pair has been merged meanwhile
        merged = symbols[i] = a + symbols[j]
        symbols[j] = ""
        right[i] = k = right[j]
        merges += 1
        if k < n:
            left[k] = i
            if (rank := ranks.get((merged, symbols[k]))) is not None:
                heappush(heap, (rank, i))
        if (k := left[i]) >= 0 and (rank := ranks.get((symbols[k], merged))) is not None:
            heappush(heap, (rank, k))
    return n - merges


class MergeCounter(Chunks):
    """Counts of whole texts for a byte-level BPE file without a normalizer."""

    def __init__(self, path: str, limit: int = 300_000):
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model, split = stated["model"], stated["pre_tokenizer"]
        if stated["normalizer"] or model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model["ignore_merges"]:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        added = stated["added_tokens"]
        special = [x["content"] for x in added]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added) or any(not c or any(map(str.isspace, c)) for c in special):
            raise ValueError(f"{path}: added tokens that reach beyond their own characters")
        self.beginnings = tuple({c[0] for c in special})
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(BYTE_LEVEL).findall
        super().__init__(limit)

    def nothing(self) -> None:
        self.words: dict[str, int] = {}

    def answer(self, chunk: str) -> int:
        if self.special is None or not any(c in chunk for c in self.beginnings) or not (found := self.special.findall(chunk)):
            return self.count(chunk)
        return len(found) + sum(map(self.count, self.special.split(chunk)))

    def count(self, text: str) -> int:
        if text.isascii() and (text.isalpha() or text[:1] == " " and text[1:].isalpha()):
            return self.word(text)
        return sum(map(self.word, self.find(text)))

    def word(self, w: str) -> int:
        n = self.words.get(w)
        if n is None:
            n = self.words[w] = merged_length(list(as_chars(w)), self.ranks)
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens and whether those are over limit. No shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in in_slices(batches, text):
            column = batch.column(text)
            n = pa.array(counter(tokenizer).counts(column), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pc.binary_length(column).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return texts_of(docs, "doc_id", text=text).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
