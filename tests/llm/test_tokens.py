import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tracelode.llm import media, packing, token_counts, token_output, tokens  # noqa: E402

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [None, "", "a", " two  blanks\n\n and\ttabs ", "x<|endoftext|>y <|startoftext|>", "ÀÉß µ ﬁ Σίγμας 日本 é", "It's we'll 12345 ²½ !!! ...", "word " * 3000, "z" * 20000, "a\x1cb\x85c", "a", "\n", "  "]
strange = st.text(alphabet=st.one_of(st.sampled_from("ab Z\n\t'sé1.,<|>endoftx²\x1c\xa0́Σ"), st.characters(codec="utf-8")), max_size=40)


@pytest.fixture(scope="module")
def library():
    return {x: Tokenizer.from_file(x) for x in (BYTE, WORD)}


@settings(max_examples=300, deadline=None)
@given(st.lists(strange, max_size=4))
def test_ids_and_counts_are_the_librarys(texts):
    column = pa.array(texts, pa.string())
    for path in (BYTE, WORD):
        plain = Tokenizer.from_file(path) if path not in CACHE else CACHE[path]
        CACHE[path] = plain
        assert [x.tolist() for x in tokens.encoder(path).encode(column)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_counts.counter(BYTE).counts(column).tolist() == [len(CACHE[BYTE].encode(t, add_special_tokens=False).ids) for t in texts]


CACHE: dict = {}


def test_kept_chunks_are_bounded():
    enc = tokens.WordEncoder(BYTE, limit=10)
    for i in range(5):
        enc.encode(pa.array([f"w{j} x" for j in range(i * 30, i * 30 + 30)]))
    assert len(enc.slots) < 70  # one batch and what was kept before it


def docs(spark, texts=TEXTS):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length long")


def test_token_records_round_trip(spark, library):
    table = docs(spark).union(docs(spark, ["a"]))  # doc_id 0 twice
    got = sorted(map(tuple, token_output.token_records(table, BYTE).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text in sorted([*enumerate(t or "" for t in TEXTS), (0, "a")]):
        ids = [*library[BYTE].encode(text, add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want


def test_records_of_no_rows(spark):
    assert token_output.token_records(docs(spark, []), BYTE).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    (shard,) = token_output.write_records(docs(spark, ["some text"]).coalesce(1), f"file://{tmp_path}", BYTE)
    path = shard["path"] + ".rec"
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(token_output.read_shard(shard["path"]))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_uses_every_piece_once(counts):
    used: dict[int, int] = {}
    bins = packing.plan(counts, 50)
    for lengths, times in bins:
        assert times > 0 and sum(lengths) <= 50
        for k in lengths:
            used[k] = used.get(k, 0) + times
    assert used == counts
    # What is left when a bin closes doesn't fit into it, so every two bins in a row hold more than one capacity.
    assert lower_bound(counts, 50) <= sum(t for _, t in bins) <= 2 * sum(k * n for k, n in counts.items()) / 50 + 1


def lower_bound(counts, capacity):
    """Bins that any packing needs: for each k, pieces over capacity - k need one each, those over half too, and what the
    pieces from k to half need beyond the room left beside the latter (Martello and Toth)."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        half = {s: n for s, n in counts.items() if capacity / 2 < s <= capacity - k}
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity / 2)
        room = sum((capacity - s) * n for s, n in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(small - room) // capacity)))
    return best


def optimum(pieces, capacity):
    """The fewest bins, by trying all."""
    best = len(pieces)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + pieces[i] <= capacity and bins[j] not in bins[:j]:
                put(i + 1, [*bins[:j], bins[j] + pieces[i], *bins[j + 1 :]])
        put(i + 1, [*bins, pieces[i]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_plan_is_near_the_optimum(pieces):
    used = sum(t for _, t in packing.plan(dict(Counter(pieces)), 20))
    best = optimum(sorted(pieces, reverse=True), 20)
    assert lower_bound(Counter(pieces), 20) <= best <= used <= best + 1


def test_plan_of_many_pieces_is_within_one_percent():
    rnd = np.random.default_rng(4)
    for spread in (0.5, 1.0, 1.5):
        counts = Counter(np.clip(rnd.lognormal(6, spread, 20_000).astype(int), 1, 4096).tolist())
        used, least = sum(t for _, t in packing.plan(dict(counts), 4096)), lower_bound_of_volume(counts, 4096)
        assert least <= used <= least * 1.01 + 1


def lower_bound_of_volume(counts, capacity):
    return max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if s > capacity / 2))


def test_two_replace_the_smallest():
    # Greedy alone fills 6 + 3 and leaves 1; 2 + 2 fit in place of 3 without a gap.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def test_packing(spark, library):
    got = packing.packed(docs(spark, [*TEXTS, *["same text"] * 300]), WORD, capacity=64).collect()
    by_doc: dict[int, list] = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in enumerate([*TEXTS, *["same text"] * 300]):
        ids = np.array([*library[WORD].encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(p.piece, p.start) for p in parts] == [(i, 64 * i) for i in range(-(-len(ids) // 64))]
        for p in parts:
            assert p.length == min(64, len(ids) - p.start) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(docs(spark, []), WORD).count() == 0


def test_counts(spark, library):
    rows = {r.doc_id: r for r in token_counts.token_counts(docs(spark), BYTE, limit=10).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library[BYTE].encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 10)


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in media.media_features(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r.payload_sha256 == __import__("hashlib").sha256(payload).hexdigest() and r.feature.startswith("audio/wav;")


def test_sniffing_validates_and_carves():
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    wav = media.wav(b"1234" * 5)
    data = b"junk BM GIF89a" + png + b"RIFF" + wav + b"%PDF-"
    assert [(k, b) for k, _, b in media.carved(data)] == [("image/png", png), ("audio/wav", wav)]
    assert media.true_type(png, "image/gif") == "image/png" and media.true_type(b"text", "text/plain") == "text/plain" and media.true_type(None, "x") is None
    assert media.sniffed(png[:-3]) == [] and media.carved(wav) == []
    bmp = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\0"
    assert media.true_type(bmp + b"more", None) == "image/bmp"
    pgm = b"P5\n2 2\n255\nabcd"
    assert media.true_type(pgm, None) == "image/x-portable-graymap"
