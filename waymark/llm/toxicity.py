"""Toxicity by compression distance of text windows.

A text in lower case without punctuation is read in windows of ``WORDS``
consecutive words.  Each window is compressed with two zstandard dictionaries,
one trained on windows of toxic texts and one on windows of ordinary texts.
Both have the same entropy tables and the same large body of ordinary text,
so a window's two lengths differ only where the part of one class serves it
better; the class's part lies behind the body, so that it is used for longer
matches only.  A window is written twice, which hides the frame's cost.

The toxic part is trained on the windows of each half of the toxic texts that a
dictionary of the other half shortens, the ordinary part on the ordinary
windows that the toxic part shortens.  Labelled rows held back from both give,
for each window length and each difference of lengths, how much oftener it
occurs in toxic texts; lengths and differences that reach ``LEAST_RATIO`` count.
A text's evidence is the log mean over its segments of ``SEGMENT`` windows of
the summed log ratios, so that a toxic passage shows in a text of any length.
The cut is the evidence that ``MOST_FALSE`` of the held-back ordinary texts
reach.

Fitting takes a bounded sample of labelled rows, in the order of a hash of
doc_id: ``MOST_DOCS`` rows and ``MOST_BYTES`` per class, of which dictionaries
read ``MOST_TRAINING`` bytes.  A text that does not fit is passed over.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import by_group, materialize, slices, tidy

MOST_DOCS = {1: 3000, 0: 4000}
MOST_BYTES, MOST_TRAINING = 12 << 20, 3 << 20
#: Words of a window, windows of a segment, and bytes after which a long word is cut.
WORDS, SEGMENT, LONGEST = 3, 400, 64
#: zstandard's level, which parses short inputs in full, the dictionaries' body, and the inputs' usual bytes.
LEVEL, BODY, SHORT = 16, 64 << 10, 128
#: Bytes of a class's part and rounds of refinement; held-back rows choose among them.
SHAPES = ((4 << 10, 1), (8 << 10, 2))
#: Cells of the table: difference in bytes, and raw length of the window in steps of six bytes.
LOW, HIGH, LENGTHS = -8, 16, 16
LEAST_RATIO, MOST_FALSE, CUT = 3.0, 0.005, 0.7
#: The least evidence that a cut may stand at, and the score of texts when nothing could be learned.
LEAST_CUT, PRIOR = 2.0, 0.01
#: Bytes of the strings by which windows are chosen for compression, and bits of their hash.
GRAM, GRAM_BITS = 7, 22
#: Windows that are compressed at a time.
BATCH = 1 << 16

_PLAIN = bytearray(range(256))
for _c in range(65, 91):
    _PLAIN[_c] += 32
for _c in b"\t\n\r\x0b\x0c.,;:!?\"'()|[]{}<>*#$%&/\\+=~^_`@-":
    _PLAIN[_c] = 32
_PLAIN = bytes(_PLAIN)
#: Ends the head of a zstandard dictionary: its three recommended repeat offsets.
_HEAD_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def _words(text: str | None) -> list[bytes]:
    words = text.encode().translate(_PLAIN).split() if text else []
    if any(len(w) > LONGEST for w in words):
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


@dataclass
class Windows:
    """The windows of some texts: plain text, where each window, with the blanks about it, begins and ends, and how many each text has."""

    plain: bytes
    begin: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> Windows:
        words = [_words(t) for t in texts]
        plain = b"".join([b" " + b" ".join(w) + b" " for w in words])
        blanks = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)
        n = np.array([len(w) for w in words], dtype=np.int64)
        # A text of no words is two blanks; one of fewer words than a window is one window.
        first = np.cumsum(np.where(n > 0, n + 1, 2)) - np.where(n > 0, n + 1, 2)
        rows = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
        place = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows) + np.repeat(first, rows)
        return cls(plain, blanks[place], blanks[place + np.repeat(np.minimum(n, WORDS), rows)] + 1, rows)

    @classmethod
    def listed(cls, found: list[bytes]) -> Windows:
        size = np.array([len(w) for w in found], dtype=np.int64)
        return cls(b"".join(found), np.cumsum(size) - size, np.cumsum(size), np.ones(len(found), dtype=np.int64))

    def texts(self, some: np.ndarray | None = None) -> list[bytes]:
        begin, end = (self.begin, self.end) if some is None else (self.begin[some], self.end[some])
        return [self.plain[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def windows(text: str | None) -> list[bytes]:
    """The windows of a text."""
    return Windows.of([text]).texts()


@lru_cache(2)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # Tables for short inputs beside a dictionary, of some megabytes; only the two of one model are kept.
    shape = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=SHORT, dict_size=len(content), write_content_size=False, write_dict_id=False)
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(compression_params=shape)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=shape)


def _sizes(content: bytes, found: list[bytes], threads: int) -> np.ndarray:
    """The compressed length of each window, written twice."""
    size = np.array([2 * len(w) for w in found], dtype=np.uint64)
    places = np.stack([np.cumsum(size) - size, size], axis=1).tobytes()
    text = zstandard.BufferWithSegments(b"".join([w + w for w in found]), places)
    return np.fromiter(map(len, _compressor(content).multi_compress_to_buffer(text, threads=threads)), dtype=np.int64, count=len(found))


def _grams(text: bytes) -> np.ndarray:
    """A hash of ``GRAM_BITS`` bits of the ``GRAM`` bytes that begin at each place."""
    raw = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(raw) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        out = out << np.uint64(8) | raw[k : k + len(out)]
    return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


@lru_cache(4)
def _own_grams(base: bytes, toxic: bytes) -> np.ndarray:
    """Which strings of ``GRAM`` bytes the toxic part has and the base has not."""
    own = np.zeros(1 << GRAM_BITS, dtype=bool)
    own[_grams(toxic)] = True
    own[_grams(base)] = False
    return own


@dataclass(frozen=True)
class Toxicity:
    """What :func:`fit` learns, under 100 KB, so it travels with the tasks."""

    base: bytes
    toxic: bytes
    ordinary: bytes
    evidence: np.ndarray
    cut: float = LEAST_CUT

    def dictionary(self, own: bytes) -> bytes:
        """The base's head, the class's part, the base's body."""
        at = self.base.find(_HEAD_END, 0, 4096)
        at = at + len(_HEAD_END) if at >= 0 else 0
        return self.base[:at] + own.rjust(max(len(self.toxic), len(self.ordinary)), b"\n") + self.base[at:]

    def differences(self, found: Windows, threads: int = 1) -> np.ndarray:
        """Bytes by which the toxic dictionary makes each window shorter than the ordinary one.

        A window none of whose strings of ``GRAM`` bytes is in the toxic part
        only has nothing to gain there: its difference counts as 0.
        """
        out = np.zeros(len(found.begin), dtype=np.int64)
        own = _own_grams(self.base, self.toxic)
        marks = np.zeros(len(found.plain) + 1, dtype=np.int32)
        for at in range(0, len(found.plain), 1 << 18):
            here = own[_grams(found.plain[at : at + (1 << 18) + GRAM - 1])]
            marks[at + 1 : at + 1 + len(here)] = here
        np.cumsum(marks, out=marks)
        some = np.flatnonzero(marks[np.maximum(found.end - GRAM + 1, found.begin)] > marks[found.begin])
        pair = [self.dictionary(self.ordinary), self.dictionary(self.toxic)]
        for at in range(0, len(some), BATCH):
            texts = found.texts(some[at : at + BATCH])
            out[some[at : at + BATCH]] = _sizes(pair[0], texts, threads) - _sizes(pair[1], texts, threads)
        return out

    def cells(self, found: Windows, threads: int = 1) -> np.ndarray:
        length = np.minimum((found.end - found.begin) // 6, LENGTHS - 1)
        return length * (HIGH - LOW + 1) + np.clip(self.differences(found, threads), LOW, HIGH) - LOW

    def of_texts(self, texts: list[str | None], threads: int = 1) -> np.ndarray:
        """The evidence of each text; 0 without words."""
        found = Windows.of(texts)
        worth = self.evidence[self.cells(found, threads)]
        ends = np.cumsum(found.rows).tolist()
        return np.array([_log_mean(worth[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Between 0 and 1; ``CUT`` where the evidence stands at the model's cut."""
        return 1 / (1 + np.exp(-np.clip(self.of_texts(texts) - self.cut + math.log(CUT / (1 - CUT)), -700, 700)))


def _log_mean(worth: np.ndarray) -> float:
    """The log of the mean over segments of exp(summed evidence)."""
    if not len(worth):
        return 0.0
    sums = np.add.reduceat(worth, np.arange(0, len(worth), SEGMENT))
    return float(sums.max() + np.log(np.exp(sums - sums.max()).mean()))


def _part(size: int, found: list[bytes]) -> bytes:
    """What a dictionary of ``size`` bytes holds after training; too few windows are its content as they are."""
    try:
        whole = zstandard.train_dictionary(max(size, 1024), found, k=16, d=8, f=20, accel=1, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[-size:]
    at = whole.find(_HEAD_END, 0, 4096)
    return whole[at + len(_HEAD_END) if at >= 0 else 0 :][-size:]


def _model(base: bytes, toxic: bytes, ordinary: bytes) -> Toxicity:
    return Toxicity(base, toxic, ordinary, np.zeros(LENGTHS * (HIGH - LOW + 1)))


def _training(texts: list[str]) -> int:
    """How many texts make the dictionaries: two thirds, or what ``MOST_TRAINING`` bytes hold; the rest calibrate."""
    size = np.cumsum([len(t.encode()) for t in texts])
    return max(1, min(len(texts) * 2 // 3, int(np.searchsorted(size, MOST_TRAINING, side="right"))))


def _candidate(base: bytes, halves: list[list[bytes]], plain: list[bytes], size: int, rounds: int) -> Toxicity:
    ordinary, parts = b"", [_part(size, h) for h in halves]
    for _ in range(rounds):
        mined = []
        for own, other in zip(halves, parts[::-1], strict=True):
            saved = _model(base, other, ordinary).differences(Windows.listed(own))
            order = np.argsort(-saved, kind="stable")[: max(100, len(own) // 20)]
            mined.append([own[i] for i in order.tolist() if saved[i] > 0])
        parts = [_part(size, m or own) for m, own in zip(mined, halves, strict=True)]
        toxic = _part(size, mined[0] + mined[1] or halves[0] + halves[1])
        saved = _model(base, toxic, b"").differences(Windows.listed(plain))
        ordinary = _part(2 * size, [plain[i] for i in np.flatnonzero(saved > 1).tolist()])
    return _model(base, toxic, ordinary)


def _table(counts: np.ndarray) -> np.ndarray:
    """Shares of the differences at each window length, drawn towards those at all lengths."""
    counts = counts.reshape(LENGTHS, -1)
    every = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * counts.shape[1])
    return ((counts + 20 * every) / (counts.sum(axis=1, keepdims=True) + 20)).ravel()


def _calibrated(model: Toxicity, toxic: list[str], ordinary: list[str]) -> tuple[float, Toxicity]:
    """The model with its table and cut, and the share of toxic texts that it finds at that cut."""
    counts = []
    for texts in (toxic, ordinary):
        n = np.zeros(LENGTHS * (HIGH - LOW + 1))
        for at in range(0, len(texts), 50):
            n += np.bincount(model.cells(Windows.of(texts[at : at + 50])), minlength=len(n))
        counts.append(n)
    ratio = _table(counts[0]) / _table(counts[1])
    kept = ratio >= LEAST_RATIO
    left = [1 - n[kept].sum() / max(1.0, n.sum()) for n in counts]
    evidence = np.where(kept, np.log(np.minimum(ratio, 1000.0)), math.log(max(left[0], 0.01) / max(left[1], 0.01)))
    model = replace(model, evidence=np.minimum(evidence, np.where(kept, evidence, 0.0)))
    clean, found = (np.concatenate([model.of_texts(x[at : at + 50]) for at in range(0, len(x), 50)]) for x in (ordinary, toxic))
    clean = np.sort(clean)
    cut = max(LEAST_CUT, float(clean[min(len(clean) - 1, int((1 - MOST_FALSE) * len(clean)))]) + 0.25)
    return float((found >= cut).mean()), replace(model, cut=cut)


def _fitted(toxic: list[str], ordinary: list[str], size: int, rounds: int) -> tuple[float, Toxicity] | None:
    """The model of one shape and the share of held-back toxic texts that it finds."""
    toxic, ordinary = ([t for t in x if windows(t)] for x in (toxic, ordinary))
    if not toxic or not ordinary:
        return None
    part = {y: _training(x) for y, x in ((1, toxic), (0, ordinary))}
    plain = sorted({w for t in ordinary[: part[0]] for w in windows(t)})
    np.random.default_rng(1).shuffle(plain)
    known = set(plain)
    halves = [sorted({w for t in toxic[h : part[1] : 2] for w in windows(t) if w not in known}) for h in (0, 1)]
    try:
        base = zstandard.train_dictionary(BODY, plain, k=16, d=8, f=20, accel=1, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        base = b"".join(plain)[-BODY:]
    model = _candidate(base, halves, plain, size, rounds)
    return _calibrated(model, toxic[part[1] :] or toxic, ordinary[part[0] :] or ordinary)


def fit_texts(toxic: list[str], ordinary: list[str]) -> Toxicity | None:
    """Learn from texts; two thirds make the dictionaries at most, the rest the table and the cut. None without both classes."""
    found = [f for size, rounds in SHAPES if (f := _fitted(toxic, ordinary, size, rounds))]
    return max(found, key=lambda f: f[0])[1] if found else None


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is kept from learning; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame, label: int) -> DataFrame:
    """(label, place, doc_id, text): a bounded sample of one class, in the order of place, doc_id and text."""
    ids = labels.where((F.col("toxic") == label) & ~held_out()).select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCS[label])
    # At most MOST_DOCS ids, so they are broadcast; longer texts could not fit in the sample.
    rows = docs.where(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(ids), "doc_id", "left_semi")
    rows = rows.select(F.lit(label).alias("label"), F.xxhash64("doc_id").alias("place"), "doc_id", "text")
    return rows.orderBy("place", "doc_id", "text").limit(2 * MOST_DOCS[label])


def _within(texts: list[str]) -> list[str]:
    """As many of the texts as ``MOST_BYTES`` hold; one that doesn't fit is passed over."""
    out, left = [], MOST_BYTES
    for text in texts:
        if (size := len(text.encode())) <= left:
            left -= size
            out.append(text)
    return out


def _fit_rows(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    """The pickled model that the sampled rows give, in the sample's order."""
    rows = pa.Table.from_batches([rows]).sort_by([(c, "ascending") for c in ("label", "place", "doc_id", "text")])
    labels = rows["label"].to_pylist()
    classes = [_within([t.as_py() for t, y in zip(rows["text"], labels, strict=True) if y == label]) for label in (1, 0)]
    model = fit_texts(*classes)
    made = pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"]) if model else None
    _compressor.cache_clear()
    return made


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity | None:
    """Learn from labelled rows that are not :func:`held_out`, a bounded sample of each class, in one task."""
    docs, labels = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select("doc_id", "toxic")
    sample = materialize(_sample(docs, labels, 1).unionByName(_sample(docs, labels, 0))).withColumn("all", F.lit(0))
    models = by_group(sample, ["all"], _fit_rows, "model binary").collect()
    return pickle.loads(models[0].model) if models else None


def with_scores(docs: DataFrame, model: Toxicity | None, score: str, text: str = "text") -> DataFrame:
    """``docs`` with the score of each whole text; null and empty texts have no evidence, all texts without a model get ``PRIOR``."""
    if model is None:
        return docs.withColumn(score, F.lit(PRIOR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = model.scores(batch[text].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, score])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``cut``) for every row of ``docs``.

    Null and empty texts have no evidence, which is below the cut. Rows that
    repeat a doc_id are scored each; of labels that repeat a doc_id or are null,
    each stated class counts once. Further columns are not read, whatever their
    names, and no rows give none. Very long texts are scored whole, in segments.
    """
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
