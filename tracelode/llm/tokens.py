"""Token ids by the tokenizers library; what it gives for a word is kept per worker."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space, as the patterns of the tokenizer files take it.
SPACE = "\t-\r \x85\xa0  -     　"
#: White space and the word behind it. No pre-token of the files goes on from a word into white space.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Of the first 256 code points: letters, digits, and those that white space and special tokens have no part in.
LETTERS, DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile("[ \n]?[!-;=-~\xa1-\xac\xae-\xff]*")
#: Fixed value: the pattern that the word tokenizer's file states.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level BPE writes each byte as a character: printable ones as themselves, the rest from code point 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_CHARS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def as_chars(word: str) -> str:
    return word.encode().decode("latin-1").translate(AS_CHARS)


class Chunks:
    """Texts as chunks at white space, each distinct chunk given once to `answer`, which subclasses define.

    A text without adjacent white space is split before single blanks and line feeds, any other at each change
    from a word to white space: the pre-tokenizers of the files split there too and look no further back, so
    the answers for the chunks put together are those for the whole text. Answers for `limit` chunks are kept,
    then all are dropped: memory doesn't grow with the corpus.
    """

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.sizes = array("i")
        self.flat = self.nothing()

    def nothing(self):
        return None

    def answer(self, chunk: str) -> int:
        """Appends the answer for one chunk to `flat`, if there is one to keep, and returns its size in tokens."""
        raise NotImplementedError

    def slots_of(self, chunks: list[str], before: str = "") -> np.ndarray:
        slots, sizes = self.slots, self.sizes
        out = np.empty(len(chunks), np.int64)
        for i, x in enumerate(chunks):
            key = before + x if x[:1] != "\n" else x
            slot = slots.get(key)
            if slot is None:
                sizes.append(self.answer(key))
                slot = slots[key] = len(sizes) - 1
            out[i] = slot
        return out

    def chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every chunk, and where each text's chunks begin (with the end)."""
        if len(self.slots) > self.limit:
            self.forget()
        texts = texts.cast(pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(texts, f"[{SPACE}][{SPACE}]").to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        begins, values = lists.offsets.to_numpy(), lists.values
        begins = np.append(begins, 0) if not len(begins) else begins.astype(np.int64)
        kinds = values.dictionary_encode()
        slots = self.slots_of(kinds.dictionary.to_pylist(), " ")[kinds.indices.to_numpy()] if len(values) else np.empty(0, np.int64)
        heads = values.take(pa.array(begins[:-1])).to_pylist()
        slots[begins[:-1]] = self.slots_of(heads)
        if len(odd):
            parts = np.split(slots, begins[1:-1]) if len(texts) else []
            for i in odd.tolist():
                parts[i] = self.slots_of(CHUNK.findall(texts[i].as_py()))
            slots = np.concatenate(parts)
            begins = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return slots, begins

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        if not len(texts):
            return np.empty(0, np.int64)
        slots, begins = self.chunked(texts)
        total = np.concatenate([[0], np.cumsum(np.frombuffer(self.sizes, np.int32)[slots], dtype=np.int64)])
        return np.diff(total[begins])


class WordEncoder(Chunks):
    """Ids of whole texts as the tokenizers library gives them for a file, without added special tokens."""

    def __init__(self, path: str, dtype: str = "<u2", limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if np.iinfo(dtype).max < self.tokenizer.get_vocab_size(with_added_tokens=True) - 1:
            raise ValueError(f"{dtype} doesn't hold the ids of {path}")
        self.dtype = np.dtype(dtype)
        stated = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (stated["normalizer"] or {}).get("normalizers", [])]
        split = stated["pre_tokenizer"]
        self.lower = steps == ["NFC", "Replace", "Lowercase"]
        self.plain = None
        if self.lower and split.get("pretokenizers", [{}])[0].get("pattern") == {"Regex": WORD_PATTERN}:
            self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
        elif not stated["normalizer"] and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            self.plain = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\\s{LETTERS}{DIGITS}]+|\\s+")
        elif not (stated["normalizer"] is None and split.get("type") == "ByteLevel") and not self.lower:
            raise ValueError(f"{path}: not known to split at white space")
        super().__init__(limit)

    def nothing(self) -> array:
        self.words: dict[str, tuple[int, int]] = {}
        return array("H" if self.dtype.itemsize == 2 else "I")

    def answer(self, chunk: str) -> int:
        """By the library. Chunks of Latin letters go to its BPE model pre-token by pre-token, split as the
        file's pre-tokenizer splits them; all others go through the whole tokenizer."""
        flat = self.flat
        if self.plain is not None and chunk.isascii() and (chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha()):
            return self.word(chunk.lower().lstrip(" ") if self.lower else chunk)
        if self.plain is None or not LATIN.fullmatch(chunk):
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            flat.extend(ids)
            return len(ids)
        return sum(map(self.word, self.plain.findall(chunk.lower() if self.lower else chunk)))

    def word(self, w: str) -> int:
        flat, known = self.flat, self.words.get(w)
        if known is not None:
            begin, end = known
            flat.extend(flat[begin:end])
            return end - begin
        begin = len(flat)
        shown = ("\u0120" + w[1:] if w[0] == " " else w) if w.isascii() and w[0] != "\n" else as_chars(w)
        flat.extend([t.id for t in self.tokenizer.model.tokenize(shown)])
        self.words[w] = begin, len(flat)
        return len(flat) - begin

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if not len(texts):
            return []
        slots, begins = self.chunked(texts)
        sizes = np.frombuffer(self.sizes, np.int32).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        n = sizes[slots]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(at[slots] - (ends - n), n) + np.arange(total)
        ids = np.frombuffer(self.flat, self.dtype)[where] if total else np.empty(0, self.dtype)
        bounds = np.concatenate([[0], ends])[begins]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str, dtype: str = "<u2") -> WordEncoder:
    """One per worker process: what it keeps serves its later tasks too."""
    return WordEncoder(path, dtype)
