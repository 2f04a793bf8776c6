"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet as log odds: the text under byte-trigram models of
each language, the language that the markup or a column declares, the address
suffix, and a prior of the host.  Host priors are counts of what the text alone
says, by grouped aggregation, each level smoothed towards the one above: host
towards its domain, domain towards all.  Declared languages and suffixes count
by how often they agree with the text over the whole table, estimated in the
same way.  A row's own text is left out of every count that judges it.  Texts without letters, or that no language's model explains better
than evenly spread trigrams, are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from waymark.llm.common import by_group, materialize, slices, tidy
from waymark.llm.shingles import text_buffers

#: Labelled texts a language is learned from, in the order of a hash of doc_id.
MOST_DOCS = 400
CELLS = 1 << 15
#: Trigrams' worth of evidence at most: neighbours overlap, so long texts must not drown all else.
MOST_TRIGRAMS = 200.0
#: Strength of each level's smoothing, in documents.
STRENGTH = 20.0

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
for _c in range(128):
    if not chr(_c).isalpha():
        _FOLD[_c] = 32


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of each byte trigram with at least two letters or non-ASCII bytes."""
    raw, offs = text_buffers(texts)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    plain = _FOLD[raw]
    row = np.repeat(np.arange(len(texts)), np.diff(offs))
    letters = (plain != 32).astype(np.int8)
    at = np.flatnonzero((row[:-2] == row[2:]) & (letters[:-2] + letters[1:-1] + letters[2:] >= 2))
    code = plain[at] << np.uint64(16) | plain[at + 1] << np.uint64(8) | plain[at + 2]
    code = code * np.uint64(0x9E3779B97F4A7C15)
    return row[at], (code >> np.uint64(64 - 15)).astype(np.int64)


@dataclass(frozen=True)
class Trigrams:
    """Languages and, for each, the log probability of every cell."""

    languages: tuple[str, ...]
    #: Of each language the cells that it has, as 16 bits, their log shares, and the log share of any other cell.
    tables: tuple[tuple[np.ndarray, np.ndarray, float], ...]

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Log likelihood of each text under each language over that of evenly spread trigrams, held to ``MOST_TRIGRAMS``."""
        row, cell = _trigrams(texts)
        n = np.bincount(row, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        for k, (cells, shares, other) in enumerate(self.tables):
            table = np.full(CELLS, other)
            table[cells] = shares
            sums[:, k] = np.bincount(row, weights=table[cell], minlength=len(texts))
        scale = np.minimum(1.0, MOST_TRIGRAMS / np.maximum(n, 1))
        return (sums + n[:, None] * np.log(CELLS)) * scale[:, None]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, cell and count of the trigrams of rows (lang, text)."""
    for batch in slices(batches, "text"):
        langs = batch["lang"].dictionary_encode()
        code = np.array(langs.indices, dtype=np.int64)
        row, cell = _trigrams(batch["text"])
        some, n = np.unique(code[row] * CELLS + cell, return_counts=True)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(some // CELLS)), pa.array(some % CELLS), pa.array(n)], ["lang", "cell", "n"])


def _packed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """One row of a language's cells, as 16 bits, and counts."""
    some = rows.filter(rows["cell"].is_valid())
    columns = [some["cell"].to_numpy().astype(np.uint16).tobytes(), some["n"].to_numpy().astype(np.int64).tobytes()]
    return pa.RecordBatch.from_arrays([rows["lang"].slice(0, 1), *[pa.array([c], pa.binary()) for c in columns]], ["lang", "cells", "counts"])


def fit(docs: DataFrame) -> Trigrams:
    """Learn every language of ``lang``, each from ``MOST_DOCS`` of its texts at most."""
    named = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = named.select("doc_id", "lang").distinct().withColumn("place", place).where(F.col("place") <= MOST_DOCS).select("doc_id", "lang")
    # At most MOST_DOCS ids a language are broadcast, so texts needn't be shuffled.
    sample = named.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", "text")
    counts = sample.mapInArrow(tidy(_counted), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # Languages whose sample has no trigrams, too.
    every = named.groupBy("lang").agg(F.lit(None).cast("long").alias("cell"), F.lit(None).cast("long").alias("n"))
    languages, tables = [], []
    for r in sorted(by_group(counts.unionByName(every), ["lang"], _packed, "lang string, cells binary, counts binary").collect(), key=lambda r: r.lang):
        cells, own = np.frombuffer(r.cells, dtype=np.uint16), np.frombuffer(r.counts, dtype=np.int64)
        total = own.sum() + 0.1 * CELLS
        languages.append(r.lang)
        tables.append((cells, np.log((own + 0.1) / total), float(np.log(0.1 / total))))
    return Trigrams(tuple(languages), tuple(tables))


def _text_evidence(rows: DataFrame, model: Trigrams, text: str, out: str) -> DataFrame:
    """``rows`` with the evidence of each text; the last class, ``und``, has what evenly spread trigrams explain: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.pad(model.evidence(batch[text]), ((0, 0), (0, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.float64()))], [*batch.schema.names, out])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _best(evidence: str) -> Column:
    """The class of most evidence; texts without any are the last."""
    full = F.reverse(F.col(evidence))
    return F.size(full) - F.array_position(full, F.array_max(full)).cast("int")


def _without(own: str, best: str) -> Column:
    """The counts ``own`` without the row itself, which is of the class ``best``."""
    return F.transform(F.col(own), lambda n, k: n - F.when(k == F.col(best), 1.0).otherwise(0.0))


def _shares(counts: Column, above: Column) -> Column:
    """Shares of ``counts`` drawn towards the shares ``above``."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda n, p: (n + STRENGTH * p) / (total + STRENGTH))


def fuse(rows: DataFrame, model: Trigrams, text: str, declared: Column, suffix: Column, host: Column, domain: Column, kept: list[str]) -> DataFrame:
    """``kept``, a struct of the kept columns of every row, then language, posterior and text_language.

    A text without evidence, null or empty, is judged by its other evidence;
    null evidence of any kind says nothing. Repeated rows count and are judged
    each; between equally likely languages the first by name is taken. Texts of
    any length have at most ``MOST_TRIGRAMS`` worth of evidence. No rows give
    none. The kept columns may have any names.
    """
    names = [*model.languages, "und"]
    facts = {"f_declared": declared, "f_suffix": suffix, "f_host": host, "f_domain": domain}
    texts = rows.select(F.col(f"`{text}`").alias("f_text"), *[c.alias(k) for k, c in facts.items()])
    # One pass over the texts leaves a row per combination of facts and best class.
    best = _text_evidence(texts, model, "f_text", "f_evidence").select(*facts, _best("f_evidence").alias("f_best"))
    cube = materialize(best.groupBy(*facts, "f_best").agg(F.count("*").cast("double").alias("n")))

    def counted(*by: str) -> DataFrame:
        """``own``, the count of each class, of each combination of ``by``."""
        each = cube.where(f"{by[0]} is not null").groupBy(*by, "f_best").agg(F.sum("n").alias("n")).groupBy(*by)
        own = F.map_from_entries(F.collect_list(F.struct("f_best", "n")))
        return each.agg(own.alias("own")).withColumn("own", F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.coalesce(F.col("own")[k], F.lit(0.0))))

    totals = np.ones(len(names))
    for r in cube.groupBy("f_best").agg(F.sum("n").alias("n")).collect():
        totals[r.f_best] += r.n
    shares = F.array(*[F.lit(float(x)) for x in totals / totals.sum()])
    none = F.array(*[F.lit(0.0)] * len(names))
    by_domain = counted("f_domain").select(F.col("f_domain").alias("d"), F.col("own").alias("d_own"))
    by_host = counted("f_host", "f_domain").join(by_domain, F.col("f_domain") == F.col("d"), "left")
    by_host = by_host.select(F.col("f_host").alias("h"), F.col("f_domain").alias("hd"), F.col("own").alias("h_own"), F.coalesce("d_own", none).alias("d_own"))

    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept")
    seen = _text_evidence(rows.select(whole, F.col(f"`{text}`").alias("f_text"), *[c.alias(k) for k, c in facts.items()]), model, "f_text", "f_evidence").drop("f_text")
    seen = seen.withColumn("f_best", _best("f_evidence"))
    seen = seen.join(by_host, (F.col("f_host") == F.col("h")) & F.col("f_domain").eqNullSafe(F.col("hd")), "left")
    # Without a domain there is nothing to leave out of its counts.
    above = F.when(F.col("f_domain").isNotNull(), _shares(_without("d_own", "f_best"), shares)).otherwise(shares)
    prior = F.when(F.col("h_own").isNotNull(), _shares(_without("h_own", "f_best"), above)).otherwise(shares)
    odds = F.zip_with("f_evidence", prior, lambda e, p: e + F.log(p))
    for c in ("f_declared", "f_suffix"):
        signal = counted(c).select(F.col(c).alias(f"{c}_is"), F.col("own").alias(f"{c}_own"))
        seen = seen.join(signal, F.col(c) == F.col(f"{c}_is"), "left")
        # P(signal | language) up to a factor: the language's share among the signal's rows over its share of all.
        likelihood = F.zip_with(_shares(_without(f"{c}_own", "f_best"), shares), shares, lambda p, q: F.log(p / q))
        odds = F.zip_with(odds, F.when(F.col(f"{c}_own").isNotNull(), likelihood).otherwise(none), lambda a, b: a + b)
    scored = seen.withColumn("f_odds", odds)
    top = F.array_max("f_odds")
    posterior = 1 / F.aggregate("f_odds", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    named = F.array(*map(F.lit, names))
    return scored.select("kept", named[F.array_position("f_odds", top).cast("int") - 1].alias("language"), posterior.alias("posterior"), named[F.col("f_best")].alias("text_language"))


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, language, posterior and text_language for every row of ``pages``; text models are learned from ``docs``.

    Null urls and html give no evidence; repeated rows are judged each; further
    columns are not read. No pages give no rows, and without documents to learn
    from every page is ``und``.

    The text is what stands outside tags, scripts, styles and comments; the
    markup declares by the html element's lang; the address gives its last
    label as suffix, its host and the host's last two labels as domain.
    """
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    rows = pages.select("page_id", text.alias("text"), _present(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))).alias("markup"), _present(host).alias("host"))
    suffix, domain = (_present(F.regexp_extract("host", p, 1)) for p in (r"\.([a-z]+)(?::\d+)?$", r"([^.]+\.[^.]+)$"))
    fused = fuse(rows, fit(docs), "text", F.col("markup"), suffix, F.col("host"), domain, ["page_id"])
    return fused.select("kept.page_id", "language", "posterior", "text_language")


def document_languages(docs: DataFrame, model: Trigrams, kept: list[str]) -> DataFrame:
    """A struct of the ``kept`` columns with language, posterior and text_language; ``lang`` is what a document declares, ``source`` its host."""
    none = F.lit(None).cast("string")
    return fuse(docs, model, "text", F.col("lang"), none, F.col("source"), none, kept)
