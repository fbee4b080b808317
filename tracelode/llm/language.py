"""Language ID by Bayesian evidence fusion (operator 3).

Four kinds of evidence are multiplied, per language: the likelihood of the page's text (byte trigrams, multinomial,
tempered so that long texts don't outvote everything), that of the language its markup declares, that of its address
suffix, and a prior of its host. The prior is hierarchically smoothed: the host's counts lean on those of its domain,
these on all pages'. All counts come from grouped aggregation of what the texts alone say; a page's own vote is taken
out before it is judged. Trigrams are learned from at most TRAIN_DOCS labelled documents (the smallest by hash).

A host, declaration or suffix that very many pages share is dealt to several tasks (spread_join).

Defined cases: null or empty pages have no text evidence and follow the rest; pages without an address have no host
and take the prior of all pages; an undeclared or unknown language is a declaration of its own; without labelled
documents the language is null and its probability 0; ties go to the first language by name; repeated rows stay;
other columns aren't read.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices, spread_join, written

TRAIN_DOCS = 3000
BITS = 15
#: Trigrams whose worth of evidence a text has at most; weight of the level above in a smoothed prior.
WORTH, LEAN = 60.0, 8.0

#: What hides all up to its closing mark, and the marks.
HIDES = re.compile(r"(?i)<(?:(script|style|noscript|template)\b|!--|!doctype)")
CLOSES = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "noscript", "template")} | {"<!--": re.compile("-->"), "<!doctype": re.compile(">")}
TAG = re.compile(r"(?s)<[^>]*>")
DECLARES = re.compile(r"(?i)<(html|meta)\b")
LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})""")
NAMED = re.compile(r"""(?i)content-language["']""")
CONTENT = re.compile(r"""(?i)content\s*=\s*["']?([a-z]{2,3})""")


def shown(page: str) -> str:
    """The page with a blank for each script, style, comment and doctype. An opening without its closing mark hides
    nothing, and once a mark isn't found it isn't looked for again: each character is passed once per kind of mark."""
    out, at, missing = [], 0, set()
    place = 0
    while m := HIDES.search(page, place):
        kind = m[1].lower() if m[1] else m[0].lower()
        end = None if kind in missing else CLOSES[kind].search(page, m.end())
        if end is None:
            missing.add(kind)
            place = m.end()
            continue
        out.append(page[at : m.start()])
        at = place = end.end()
    return " ".join([*out, page[at:]])


def visible(page: str) -> str:
    text = shown(page)
    last = text.rfind(">") + 1  # no tag begins behind it
    return markup.unescape(TAG.sub(" ", text[:last]) + text[last:])


def declared(page: str) -> str:
    """The language that the first html or meta element with one declares. Of openings without a `>` between them only
    the first of a kind is looked at: a later one would find less of the same."""
    looked = {"html": -1, "meta": -1}
    end = -1
    for m in DECLARES.finditer(page):
        kind = m[1].lower()
        if m.start() >= end:
            end = page.find(">", m.end())
            end = len(page) if end < 0 else end
        if looked[kind] == end:
            continue
        looked[kind] = end
        if kind == "html":
            found = LANG.search(page, m.end(), end)
        else:
            named = NAMED.search(page, m.end(), end)
            found = CONTENT.search(page, named.end(), end) if named else None
        if found:
            return found[1].lower()
    return ""


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts (lower-cased, letters only), and where each text's begin (with the end)."""
    raws = [re.sub(r"[\W\d_]+", " ", f" {t.lower()} ").encode() for t in texts]
    data = np.frombuffer(b"".join(raws) + b"  ", np.uint8).astype(np.uint32)
    grams = ((data[:-2] * 0x9E3779B1 + data[1:-1] * 0x85EBCA77 + data[2:] * 0xC2B2AE3D) >> np.uint32(32 - BITS)).astype(np.int64)
    begins = np.cumsum([0] + [len(r) for r in raws])
    inside = np.ones(len(grams), bool)
    inside[begins[1:] - 1] = inside[np.maximum(begins[1:] - 2, 0)] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    return grams[inside], kept[np.minimum(begins, len(grams))]


class Trigrams:
    """Log-probabilities of trigrams by language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.array([counts[k] for k in self.languages], np.float64).reshape(len(counts), 1 << BITS) + 0.5
        self.logs = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Per text and language, the tempered log-likelihood less that of the likeliest language."""
        grams, at = trigrams(texts)
        n = np.maximum(np.diff(at), 1)
        out = np.zeros((len(texts), len(self.languages)))
        for k, row in enumerate(self.logs):
            total = np.concatenate([[0.0], np.cumsum(row[grams], dtype=np.float64)])
            out[:, k] = (total[at[1:]] - total[at[:-1]]) * np.minimum(1, WORTH / n)
        return out - out.max(axis=1, keepdims=True) if len(self.languages) else out


def learned(docs: DataFrame) -> Trigrams:
    """From the texts and lang of the sampled documents; only counts by language reach the driver."""
    known = docs.where("lang is not null and lang <> '' and text is not null")
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    some = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in in_slices(batches):
            grams, at = trigrams(texts)
            for lang, a, b in zip(batch.column("lang").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                np.add.at(sums[lang], grams[a:b], 1)
        for lang, n in sorted(sums.items()):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "gram", "n"])

    summed = some.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = summed.toArrow()  # at most 2**BITS rows a language of the sample
    total: dict[str, np.ndarray] = {}
    for lang in pa.compute.unique(table.column("lang")).to_pylist():
        own = table.filter(pa.compute.equal(table.column("lang"), lang))
        total[lang] = np.zeros(1 << BITS, np.int64)
        total[lang][own.column("gram").to_numpy()] = own.column("n").to_numpy()
    return Trigrams(total)


def address(url: Column) -> dict[str, Column]:
    """Host, domain, suffix (the last label) and the number that its path ends in. The domain is the last two labels, or
    three where the second last is one that countries register under (co.uk)."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return {
        "host": host,
        "domain": F.regexp_extract(host, r"([^.]+\.(?:(?:ac|co|com|edu|go|gob|gov|ne|net|or|org)\.[a-z]{2}|[^.]+))$", 1),
        "suffix": F.regexp_extract(host, r"([^.]+)$", 1),
        "doc_id": F.nullif(F.regexp_extract(url, r"^[^?#]*/(\d{1,18})(?:\.\w+)?/?(?:[?#].*)?$", 1), F.lit("")).cast("long"),
    }


def votes(df: DataFrame, languages: list[str], *by: str) -> DataFrame:
    """By the columns, an array (n) of how many pages' texts say each language, and their sum (rows)."""
    sums = F.array(*[F.sum((F.col("said") == k).cast("double")) for k in range(len(languages))])
    return df.groupBy(*by).agg(sums.alias("n"), F.count("*").alias("rows"))


def judged(pages: DataFrame, model: Trigrams) -> DataFrame:
    """Per row of pages: page_id, doc_id (the number in its address), lang, probability, text_lang, declared, suffix, host."""
    languages = model.languages
    if not languages:
        parts = address(F.col("url"))
        return pages.select("page_id", parts["doc_id"].alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), parts["suffix"].alias("suffix"), parts["host"].alias("host"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches, "html"):
            logs = model.likelihoods([visible(t) for t in texts])
            columns = [*(batch.column(c) for c in NAMES), pa.array(list(logs), pa.list_(pa.float64())), pa.array(logs.argmax(axis=1).astype(np.int32)), pa.array([declared(t) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*NAMES, "logs", "said", "declared"])

    parts = address(F.col("url"))
    rows = pages.select("page_id", *[F.coalesce(v, F.lit("")).alias(k) if k != "doc_id" else v.alias(k) for k, v in parts.items()], F.coalesce("html", F.lit("")).alias("html"))
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in NAMES)
    read_ = written(rows.mapInArrow(read, f"{schema}, logs array<double>, said int, declared string"), "evidence")

    every = votes(read_, languages).first()
    total = [float(x or 0) for x in every.n]
    hosts = written(votes(read_, languages, "domain", "host"), "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("n")[k]) for k in range(len(languages))]).alias("domain_n"), F.count("*").alias("hosts"))
    levels = spread_join(hosts.withColumnRenamed("n", "host_n").withColumnRenamed("rows", "pages"), domains, ["domain"], "hosts")
    marks = votes(read_, languages, "declared").withColumnRenamed("n", "declared_n")
    ends = votes(read_, languages, "suffix").withColumnRenamed("n", "suffix_n")
    joined = spread_join(spread_join(spread_join(read_, levels, ["domain", "host"], "pages"), marks, ["declared"], "rows"), ends, ["suffix"], "rows")

    size = len(languages)
    whole = sum(total)

    def own(k: int) -> Column:
        return (F.col("said") == k).cast("double")

    def share(k: int, column: str, above: Column) -> Column:
        """The smoothed share of language k among the votes of a group, without the page's own."""
        n = sum((F.col(column)[j] for j in range(size)), F.lit(0.0))
        return (F.col(column)[k] - own(k) + LEAN * above) / (n - 1 + LEAN)

    def chance(k: int, column: str) -> Column:
        """How likely pages of language k have this evidence, without the page's own vote."""
        return (F.col(column)[k] - own(k) + 0.5) / (F.lit(total[k]) - own(k) + 2.0)

    fused = []
    for k in range(size):
        everywhere = (F.lit(total[k]) - own(k) + 1.0) / (whole - 1.0 + size)
        prior = share(k, "host_n", share(k, "domain_n", everywhere))
        fused.append(F.col("logs")[k] + F.ln(prior) + F.ln(chance(k, "declared_n")) + F.ln(chance(k, "suffix_n")))
    scored = joined.withColumn("fused", F.array(*fused)).withColumn("most", F.array_max("fused"))
    names = F.array(*[F.lit(x) for x in languages])
    mass = F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    return scored.select(
        "page_id", "doc_id", F.element_at(names, F.array_position("fused", F.col("most")).cast("int")).alias("lang"), (1.0 / mass).alias("probability"),
        F.element_at(names, F.col("said") + 1).alias("text_lang"), "declared", "suffix", "host",
    )


NAMES = ["page_id", "host", "domain", "suffix", "doc_id"]
