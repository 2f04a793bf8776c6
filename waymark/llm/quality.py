"""Quality rules: isolation forests on rule statistics of whole texts.

One forest splits at random statistics, and one more for each statistic splits
at it alone: a kind of junk that many rows share hides itself in the joint
forest, and stands apart along its own statistic.  All labelled rows that pass
the base rules take part, a third of their ids (by a hash) in calibrating and
the others in growing: each tree draws its own ``SUBSAMPLE`` of these, as
isolation forests do.  In each forest a text has its mean path length to a leaf;
short paths mark anomalies.  The cut of each forest is calibrated on every row
of the third that it has not seen: the one by which most rows of quality 0 go
for each of quality 1 that goes with them (found less lost), if that is
``LEAST_GAIN`` or more of the rows of quality 0.  A text that is below any cut
is rejected.

Texts are read once; the rest works on a table of their statistics.  The driver
gets what trees draw and sums by stretches of path length, which don't grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waymark.llm.common import forget, materialize, slices, tidy
from waymark.llm.shingles import PLACE, mix, text_buffers, word_hashes

TREES, SUBSAMPLE, SEED = 25, 256, 11
LEAST_GAIN = 0.03
#: Stretches of a path length of one within which sums of gains are ordered, and rows that are hashed for all trees at a time.
STRETCHES, LOT = 64, 4096
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_KIND = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".!?;:", "line": b"\n"}
_IS = {k: np.isin(np.arange(256), list(v)) for k, v in _KIND.items()}
_COUNTED = [*STATISTICS, *_KIND]
_PASSED = "n_words >= 50 and 100 * n_repeat_words <= 50 * n_words"


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rule statistics of each text."""
    raw, offs = text_buffers(texts)
    words, bounds = word_hashes(raw, offs, fold=False)
    n = len(texts)
    starts = np.zeros(len(raw) + 1, dtype=np.int64)

    def per_row(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=starts[1:])
        return starts[offs[1:]] - starts[offs[:-1]]

    space = np.isin(raw, [32, 9, 10, 11, 12, 13])
    out = {"n_words": np.diff(bounds), "word_chars": per_row(((raw & 0xC0) != 0x80) & ~space), "n_symbols": per_row(_SYMBOL[raw])}
    out |= {k: per_row(mask[raw]) for k, mask in _IS.items()}
    out["n_dup_lines"], out["n_repeat_words"] = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    data = raw.tobytes()
    for i in range(n):
        lines = [x for x in data[offs[i] : offs[i + 1]].split(b"\n") if x.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    if len(words) >= 3:
        row = np.repeat(np.arange(n), np.diff(bounds))
        runs = mix(words[:-2] * PLACE[0] + words[1:-1] * PLACE[1] + words[2:] * PLACE[2])
        at = np.flatnonzero(row[:-2] == row[2:])
        # Windows are compared within their row: its number goes into the hash.
        own = mix(runs[at] + row[at].astype(np.uint64) * PLACE[3])
        _, which, often = np.unique(own, return_inverse=True, return_counts=True)
        again = at[often[which.ravel()] > 1]
        covered = np.zeros(len(words), dtype=bool)
        for k in range(3):
            covered[again + k] = True
        out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    lines = s["line"] + 1
    rates = [s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["upper"] / chars, s["digit"] / chars, s["stop"] / words]
    # Rates are spread over orders of size, so they are split on a logarithmic scale.
    return np.stack([np.log(words), np.log(chars / words), *[np.log1p(1000 * r) for r in rates]], axis=1)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _leaf_path(n: int) -> float:
    """The mean path of a failed search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forests:
    """Trees by forest as arrays: column (-1 at a leaf), split, left child and path length; the right child follows the left."""

    column: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    cuts: np.ndarray

    def paths(self, x: np.ndarray) -> np.ndarray:
        """The mean path of each row in each forest."""
        out = np.zeros((len(x), len(self.column)))
        for k in range(len(self.column)):
            for column, split, child, path in zip(self.column[k], self.split[k], self.child[k], self.path[k], strict=True):
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    c = column[at]
                    inner = c >= 0
                    if not inner.any():
                        break
                    go = x[np.arange(len(x)), np.maximum(c, 0)] >= split[at]
                    at = np.where(inner, child[at] + go, at)
                out[:, k] += path[at]
        return out / self.column.shape[1]

    def rejected(self, paths: np.ndarray) -> np.ndarray:
        return (paths < self.cuts).any(axis=1)


def grow_on(drawn: list[np.ndarray], seed: int = SEED) -> Forests:
    """A forest over all columns and one over each of them, without cuts; each tree has drawn its own rows."""
    rng = np.random.default_rng(seed)
    size, columns_ = max(len(x) for x in drawn), drawn[0].shape[1]
    depth = int(np.ceil(np.log2(max(size, 2))))
    groups = [list(range(columns_)), *[[c] for c in range(columns_)]]
    shape = (len(groups), TREES, 4 * size)
    column, split, child, path = np.full(shape, -1), np.zeros(shape), np.zeros(shape, dtype=np.int64), np.zeros(shape)
    for g, columns in enumerate(groups):
        for t in range(TREES):
            todo, used = [(0, drawn[g * TREES + t], 0)], 1
            while todo:
                node, rows, level = todo.pop()
                low, high = rows[:, columns].min(axis=0), rows[:, columns].max(axis=0)
                open_ = np.flatnonzero(high > low)
                if level >= depth or len(rows) < 2 or not len(open_):
                    path[g, t, node] = level + _leaf_path(len(rows))
                    continue
                k = rng.choice(open_)
                c, at = columns[k], rng.uniform(low[k], high[k])
                at = at if at > low[k] else high[k]
                column[g, t, node], split[g, t, node], child[g, t, node] = c, at, used
                right = rows[:, c] >= at
                todo += [(used, rows[~right], level + 1), (used + 1, rows[right], level + 1)]
                used += 2
    return Forests(column, split, child, path, np.full(len(groups), -np.inf))


def grow(x: np.ndarray, seed: int = SEED) -> Forests:
    """``grow_on`` rows drawn from ``x``."""
    rng = np.random.default_rng(seed)
    return grow_on([x[rng.choice(len(x), min(SUBSAMPLE, len(x)), replace=False)] for _ in range((x.shape[1] + 1) * TREES)], seed)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return features({c: batch[c].to_numpy() for c in _COUNTED})


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of ``docs``, written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = statistics(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(s[c].astype(np.int64)) for c in _COUNTED]], ["doc_id", *_COUNTED])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(plain.mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTED)))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, unseen, place, times, the statistics) of all ``measured`` rows that pass the base rules and have a label.

    Each row of an id counts, equal ones as one row of so many ``times``; all are
    seen or all are not. Of an id's labels the greatest holds.
    """
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    # Copies are counted before the join, so that nothing keeps Spark from splitting a frequent id in it.
    found = rows.where(_PASSED).groupBy("doc_id", *_COUNTED).agg(F.count("*").alias("times")).join(marks, "doc_id")
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2
    return found.select((F.col("quality") == 1).alias("good"), unseen.alias("unseen"), F.xxhash64("doc_id", *_COUNTED).alias("place"), "times", *_COUNTED)


def draw(rows: DataFrame, n: int, samples: int, seed: int = SEED) -> list[np.ndarray]:
    """Features of ``SUBSAMPLE`` of the ``n`` ``labelled`` rows (of all if there are fewer), drawn ``samples`` times without replacement.

    A draw takes the rows of least hashes, each draw by a hash of its own. Rows
    under a bound come to the driver, half as many again as are drawn.
    """
    size, names = min(SUBSAMPLE, n), [f"x{i}" for i in range(8)]
    salts = mix(np.arange(1, samples + 1, dtype=np.uint64) * PLACE[1] + np.uint64(seed))
    wanted = size + 8 * int(np.ceil(np.sqrt(size)))
    while True:
        bound = np.uint64(min(wanted * 2**64 // n, 2**64 - 1))

        def run(batches: Iterator[pa.RecordBatch], bound: np.uint64 = bound) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, times, place = _features(batch), batch["times"].to_numpy(), batch["place"].to_numpy().view(np.uint64)
                ends = np.cumsum(times)
                for at in range(0, int(ends[-1]), LOT):
                    copy = np.arange(at, min(at + LOT, int(ends[-1])))
                    row = np.searchsorted(ends, copy, side="right")
                    own = mix(place[row] + (ends[row] - copy).astype(np.uint64) * PLACE[0])
                    hashes = mix(own[:, None] + salts)
                    i, sample = np.nonzero(hashes <= bound)
                    yield pa.RecordBatch.from_arrays([pa.array(sample.astype(np.int32)), pa.array(hashes[i, sample].view(np.int64)), *[pa.array(x[row[i], c]) for c in range(8)]], ["sample", "hash", *names])

        found = rows.mapInArrow(run, "sample int, hash long, " + ", ".join(f"{c} double" for c in names)).toArrow()
        sample, hashes = found["sample"].to_numpy(), found["hash"].to_numpy().view(np.uint64)
        x = np.stack([found[c].to_numpy() for c in names], axis=1)
        order = np.lexsort((hashes, sample))
        starts = np.searchsorted(sample[order], np.arange(samples + 1))
        if (np.diff(starts) >= size).all():
            return [x[order[k : k + size]] for k in starts[:-1]]
        wanted *= 2


def best_cuts(judged: DataFrame, forests: list[int]) -> list[tuple[int, float, int]]:
    """For each of the forests how many more poor rows than good ones go below its best cut, that cut, and less its number.

    Of rows (gain, p0, p1, ..), gain being positive for poor rows. Rows of equal
    paths go together, the least of equally good cuts counts, and none is above all rows.
    """
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("path")) for k in forests]))
    sums = judged.select("gain", ways.alias("w")).groupBy("w.k", "w.path").agg(F.sum("gain").alias("gain"))
    own = W.partitionBy("k", "stretch").orderBy("path")
    ranked = sums.withColumn("stretch", F.floor(F.col("path") * STRETCHES)).select("k", "stretch", "path", F.sum("gain").over(own).alias("sum"), F.lead("path").over(own).alias("above"))
    inner = F.when(F.col("above").isNotNull(), F.struct("sum", (-F.col("path")).alias("less"), "above"))
    parts = ranked.groupBy("k", "stretch").agg(F.min("path").alias("first"), F.max(F.struct("path", "sum")).alias("last"), F.max(inner).alias("inner"))
    found: dict[int, list[tuple[int, float, float]]] = {k: [] for k in forests}
    before: dict[int, tuple[int, float]] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["k"], r["stretch"])):
        total = 0
        if r["k"] in before:
            total, last = before[r["k"]]
            found[r["k"]].append((total, -last, r["first"]))
        if r["inner"]:
            found[r["k"]].append((total + r["inner"]["sum"], r["inner"]["less"], r["inner"]["above"]))
        before[r["k"]] = (total + r["last"]["sum"], r["last"]["path"])
    best = {k: max(v) for k, v in found.items() if v}
    return [(gain, (above - less) / 2, -k) for k, (gain, less, above) in best.items()]


def calibrated(forests: Forests, rows: DataFrame, poor: int) -> Forests:
    """The forests with cuts by all ``labelled`` rows given, of which ``poor`` are of quality 0."""
    n = len(forests.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, times = forests.paths(_features(batch)), batch["times"].to_numpy()
            gain = np.where(batch["good"].to_numpy(zero_copy_only=False), -times, times)
            yield pa.RecordBatch.from_arrays([pa.array(gain), *[pa.array(paths[:, k].copy()) for k in range(n)]], ["gain", *[f"p{k}" for k in range(n)]])

    judged = materialize(rows.mapInArrow(run, "gain long, " + ", ".join(f"p{k} double" for k in range(n))))
    left, cuts = judged, forests.cuts.copy()
    least = max(2.0, LEAST_GAIN * poor)
    # The forest that gains most first, and the next on what it leaves.
    while uncut := np.flatnonzero(np.isinf(cuts)).tolist():
        gain, cut, k = max(best_cuts(left, uncut), default=(0, -np.inf, 0))
        if gain < least:
            break
        cuts[-k] = cut
        left = left.where(F.col(f"p{-k}") >= cut)
    forget(rows.sparkSession, judged)
    return replace(forests, cuts=cuts)


def fit(rows: DataFrame, labels: DataFrame) -> Forests:
    """Forests and cuts from ``measured`` rows; without labelled rows of both kinds nothing is cut."""
    found = materialize(labelled(rows, labels))
    counts = {r["unseen"]: (r["n"], r["good"]) for r in found.groupBy("unseen").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("good"), F.col("times")).otherwise(0)).alias("good")).collect()}
    total = [sum(c) for c in zip(*counts.values(), strict=True)] or [0, 0]
    if total[0] < 2:
        shape = (1, 1, 1)
        return Forests(np.full(shape, -1), np.zeros(shape), np.zeros(shape, dtype=np.int64), np.zeros(shape), np.full(1, -np.inf))
    # Where one side has no rows, all serve for both.
    sides = [(found.where(F.col("unseen") == side), *counts[side]) if len(counts) == 2 else (found, *total) for side in (False, True)]
    (seen, n, _), (rest, m, good) = sides
    forests = grow_on(draw(seen, n, 9 * TREES))
    if 0 < good < m:
        forests = calibrated(forests, rest, m - good)
    forget(rows.sparkSession, found)
    return forests


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, kept and path for every row of ``docs``.

    kept is false where the base rules fail and else whether no forest's path
    is shorter than its calibrated cut; path is that of the joint forest. Null and empty texts have zeros and fail.
    Repeated rows are judged each, and each counts in fitting where its id has a
    label; rows of null ids are judged only. Without labels of both kinds the
    forests reject nothing. Further columns are not read. No rows give none.
    """
    rows = measured(docs)
    forests = fit(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, failed = forests.paths(_features(batch)), base_failed({c: batch[c].to_numpy() for c in STATISTICS})
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("doc_id", *STATISTICS)], pa.array(failed), pa.array(~failed & ~forests.rejected(paths)), pa.array(paths[:, 0].copy())], ["doc_id", *STATISTICS, "base_failed", "kept", "path"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS) + ", base_failed boolean, kept boolean, path double")
