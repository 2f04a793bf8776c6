"""Language-model scoring: cross-entropy difference of a target and a background model.

Both models are interpolated bigram models over lower-cased words.  Words and
bigrams are counted one by one, by 64-bit hashes, so what is counted grows with
the corpus.  Documents are dealt out in chunks of about ``CHUNK_BYTES``.  A
chunk asks for each of its distinct words and bigrams once and brings its own
counts of them, so a word that is everywhere costs a row a chunk.  Buckets of
hashes add up the chunks' counts and answer each chunk; no table of them goes
to the driver or to all tasks.  Documents of one id share a chunk with its
label; those of an id that very many repeat are dealt over all chunks instead.
A document's score is the mean over its words of target loss minus background
loss, in nats; low scores are like the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import HOT, by_group, map_text, materialize, partitions
from waymark.llm.shingles import PLACE, mix, text_buffers, word_hashes

#: Classes of the uniform part, the same for both models whatever the vocabulary.
CELLS = 1 << 20
#: Bytes of a chunk's texts, and corpus words for each bucket of hashes, on average.
CHUNK_BYTES, BUCKET_WORDS = 1 << 22, 3 << 18
#: Rows of one id that are not dealt out, however small the table.
LEAST_HOT = 1000
#: Weights of the bigram, word and uniform parts.
PARTS = (0.5, 0.4, 0.1)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word; word index of each second of a pair; distinct hashes, and which each word, then each pair, has."""
    raw, offs = text_buffers(texts)
    words, bounds = word_hashes(raw, offs)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = np.flatnonzero(row[1:] == row[:-1]) + 1
    pair = mix(words[at - 1] * PLACE[0] + words[at] * PLACE[1])
    distinct, which = np.unique(np.concatenate([words, pair]), return_inverse=True)
    return row, at, distinct, which.ravel()


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers by place of their bytes, so that those of little use compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _ask(rows: pa.RecordBatch, buckets: int) -> pa.RecordBatch | None:
    """A row for each bucket with the chunk's hashes there, as steps, and its counts over all and over target documents."""
    docs = rows.filter(pc.invert(rows["is_label"]))
    marked = rows.filter(rows["is_label"])["doc_id"]
    row, at, distinct, which = _grams(docs["text"])
    if not len(distinct):
        return None
    target = pc.or_(pc.is_in(docs["doc_id"], value_set=marked), docs["sure"].fill_null(False))
    inside = np.array(target, dtype=bool)[row]
    counts = [np.bincount(which, minlength=len(distinct)), np.bincount(which[np.concatenate([inside, inside[at]])], minlength=len(distinct))]
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(distinct)]
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    steps = [_planes(np.diff(distinct[a:b], prepend=np.uint64(0))) for a, b in spans]
    columns = [pa.array(steps, pa.binary()), *[pa.array([_planes(n[a:b]) for a, b in spans], pa.binary()) for n in counts]]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([rows["chunk"][0].as_py()] * len(spans), pa.int64()), *columns], ["bucket", "chunk", "steps", "background", "target"])


def _answer(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The counts of the corpus for the hashes of each row, in its order."""
    hashes = [np.cumsum(_numbers(x.as_py()), dtype=np.uint64) for x in rows["steps"]]
    edges = np.cumsum([0, *map(len, hashes)]).tolist()
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    which, columns = which.ravel(), []
    for c in ("background", "target"):
        own = np.concatenate([_numbers(x.as_py()) for x in rows[c]])
        total = np.bincount(which, weights=own, minlength=len(distinct)).astype(np.int64)[which]
        columns.append(pa.array([_planes(total[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays([rows["chunk"], rows["bucket"], *columns], ["chunk", "bucket", "background", "target"])


def _losses(counts: np.ndarray, at: np.ndarray, n_words: int, total: int) -> np.ndarray:
    """The loss of each word under one model; ``counts`` are of the words, then of the pairs."""
    words, pairs = counts[:n_words], counts[n_words:]
    p = PARTS[1] * words / max(1, total) + PARTS[2] / CELLS
    p[at] += PARTS[0] * pairs / np.maximum(words[at - 1], 1)
    return -np.log(p)


def _scores(rows: pa.Table, answers: pa.Table, totals: dict[str, int]) -> pa.Table:
    """The result's rows of a chunk's documents."""
    docs = rows.filter(pc.invert(rows["is_label"])).combine_chunks()
    texts = pa.concat_arrays(docs["text"].chunks) if docs.num_rows else pa.array([], pa.string())
    row, at, _, which = _grams(texts)
    n = np.bincount(row, minlength=len(texts))
    answers, loss = answers.sort_by("bucket"), []
    for c, total in totals.items():
        counts = np.concatenate([np.zeros(0), *[_numbers(x.as_py()) for x in answers[c]]])
        loss.append(np.bincount(row, weights=_losses(counts[which], at, len(row), total), minlength=len(texts)) / np.maximum(n, 1))
    none = n == 0
    return pa.table([docs["doc_id"], pa.array(n.astype(np.int64)), *[pa.array(x, mask=none) for x in (*loss, loss[0] - loss[1])]], ["doc_id", "n_words", "target_loss", "background_loss", "score"])


def _sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offs = text_buffers(batch["text"])
    _, bounds = word_hashes(raw, offs)
    return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(offs)), pa.array(np.diff(bounds).astype(np.int64))], ["doc_id", "bytes", "words"])


def score(docs: DataFrame, labels: DataFrame, good: int = 1) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score for every row of ``docs``.

    The target is the documents whose label has quality ``good``, the
    background all documents. Null, empty and wordless texts have 0 words and
    null losses and score. A repeated doc_id is in the target if any of its
    labels says so; null ids are not. Further columns are not read, and no rows
    give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = labels.where((F.col("quality") == good) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("chosen")).distinct()
    sizes = materialize(map_text(docs, "text", _sizes, "doc_id long, bytes long, words long"))
    # Ids that more than a HOTth of the rows repeat: fewer than HOT of them, so they are broadcast.
    often = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > F.greatest(F.lit(sizes.count() / HOT), F.lit(LEAST_HOT)))
    hot = materialize(often.join(chosen, F.col("doc_id") == F.col("chosen"), "left").select(F.col("doc_id").alias("hot_id"), F.col("chosen").isNotNull().alias("sure")))
    marked = sizes.join(chosen, F.col("doc_id") == F.col("chosen"), "left")
    sums = [F.count("*"), F.sum("bytes"), F.sum("words"), F.sum(F.when(F.col("chosen").isNotNull(), F.col("words")))]
    n, size, words, target = (x or 0 for x in marked.agg(*sums).first())
    size += 64 * n
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-words // BUCKET_WORDS))

    # Labels go to the chunk of their document, so texts are shuffled once; null and hot ids are spread.
    spread = F.col("hot_id").isNotNull() | F.col("doc_id").isNull()
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(chunks))
    rows = docs.join(F.broadcast(hot), F.col("doc_id") == F.col("hot_id"), "left").withColumn("nth", F.monotonically_increasing_id())
    rows = rows.select(F.when(spread, place("nth")).otherwise(place("doc_id")).alias("chunk"), "doc_id", "text", "sure", F.lit(False).alias("is_label"))
    marks = chosen.select(place("chosen").alias("chunk"), F.col("chosen").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("sure"), F.lit(True).alias("is_label"))
    rows = rows.unionByName(marks).repartition(partitions(docs.sparkSession, size), "chunk")
    asked = by_group(rows, ["chunk"], lambda x: _ask(x, buckets), "bucket long, chunk long, steps binary, background binary, target binary", size)
    answers = by_group(asked, ["bucket"], _answer, "chunk long, bucket long, background binary, target binary", 4 * size)
    totals = {"target": target, "background": words}
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda x, y: _scores(x, y, totals), "doc_id long, n_words long, target_loss double, background_loss double, score double")
