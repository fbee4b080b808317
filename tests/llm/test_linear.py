"""Work on long texts grows with them: what marks begin and never end is passed once. And what is found stays."""

import random
import re
import time

import pytest

from tracelode.llm import language, media, secrets

#: As the page was read before: each opening searches on for its own closing mark.
HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>")
DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})|<meta\b[^>]*?content-language["'][^>]*?content\s*=\s*["']?([a-z]{2,3})""")


def seconds(f, x):
    began = time.thread_time()
    f(x)
    return time.thread_time() - began


@pytest.mark.parametrize(
    ("f", "part"),
    [(f, p) for f in (language.visible, language.declared) for p in ("<!--", "<script>", "<html ", "<", "<meta content-language' ", "<!doctype ")]
    + [(lambda t: secrets.base_spans(t, t.encode()), "é" + "0123456789abcdef" * 2 + " "), (lambda t: secrets.base_spans(t, t.encode()), "0123456789abcdef" * 2 + " ")],
)
def test_texts(f, part):
    small, large = part * (500_000 // len(part)), part * (5_000_000 // len(part))
    assert seconds(f, large) < 0.3 + 23 * max(seconds(f, small), 0.01) and seconds(f, large) < 10


@pytest.mark.parametrize("part", [b"GIF87a1234567!x", b"\0\0\0\x10ftypisom1234", b"OggS\0\0" + b"\0" * 20 + b"\1\1x", b"GIF89a1234567,12345678\0\0\2"])
def test_bytes(part):
    small, large = part * (20_000 // len(part)), part * (200_000 // len(part))
    assert seconds(media.sniffed, large) < 0.5 + 23 * max(seconds(media.sniffed, small), 0.01)


def test_pages_as_before():
    rng = random.Random(3)
    pool = ["<script>", "</script >", "</SCRIPT>", "<style x>", "</style>", "<!--", "-->", "<!doctype ", "<!DOCTYPE html>", "<html ", "lang=", "'en'", ' lang = "fr"', "<meta ", "content-language'", " content='de'", " content=it", ">", "<", "</p>", "<p>", "text", " ", "x<scripty>", "\n", "&amp;", "<HTML>"]
    for _ in range(30_000):
        page = "".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        m = DECLARED.search(page)
        assert language.shown(page) == HIDDEN.sub(" ", page), page
        assert language.declared(page) == ((m[1] or m[2]).lower() if m else ""), page
        assert language.visible(page) == language.markup.unescape(language.TAG.sub(" ", HIDDEN.sub(" ", page))), page


def test_spans_in_code_points():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["é", "中", "0123456789abcdef" * 2, "x", " ", "AKIA" + "Z" * 16, "token=abcdefgh", "😀"]) for _ in range(12))
        want = sorted([(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24])
        assert [(s, e) for s, k, e, _ in secrets.base_spans(text, text.encode()) if k == 2] == want


def test_walks_as_before():
    """Media one behind the other and inside each other, against walks from each hit."""

    def gif(b, at):
        if at + 13 > len(b):
            return None
        i = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
        while i < len(b):
            if b[i] == 0x3B:
                return i + 1 - at
            if b[i] == 0x21:
                i += 2
            elif b[i] == 0x2C and i + 10 <= len(b):
                i += 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0)
            else:
                return None
            while i < len(b) and b[i]:
                i += b[i] + 1
            i += 1
        return None

    rng = random.Random(5)
    for _ in range(3000):
        data = b"".join(rng.choice([b"GIF89a", b"GIF87a1234\x80\0\0", b"\0" * 7, b"!\xf9\4abcd\0", b",12345678\0\2\3abc\0", b";", b"\1x\0", b"\0\0\0\x10ftypisom\0\0\0\0", b"OggS\0\4" + b"\0" * 20 + b"\1\2ab", b"OggS\0\0" + b"\0" * 20 + b"\0"]) for _ in range(rng.randrange(12)))
        found = media.sniffed(data)
        assert [(at, n) for k, at, n in found if k == "image/gif"] == [(at, n) for at in range(len(data)) if data[at : at + 6] in (b"GIF87a", b"GIF89a") and (n := gif(data, at)) is not None]
