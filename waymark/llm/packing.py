"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Texts longer than a bin are cut into pieces of one bin and a rest.  Pieces go
to shards by a hash, of about ``SHARD_PIECES`` each, and every shard is packed
on its own, largest piece first.  Its open bins are ordered by residual; the
search starts at the first that is large enough and goes on to successors
until the tightest compatible one.  A bin carries a bitmap of its sources and
one of its duplicate clusters, and takes no second piece of either, nor of the
same document.  Full pieces are bins of their own and need no search.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import by_group, join_hot, materialize, word_count
from waymark.llm.near_dedup import grouped, near_groups, signed

CAPACITY, SHARD_PIECES = 2048, 4096
#: Copies of one row that a task lists.
LOT = 1024


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, in the order given; sources and clusters are small numbers, -1 conflicts with nothing."""
    bins = np.empty(len(sizes), dtype=np.int64)
    open_: list[tuple[int, int]] = []
    marks: list[tuple[int, int]] = []
    for k, (size, source, cluster) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)):
        s, c = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(open_, (size, -1))
        while at < len(open_) and (marks[open_[at][1]][0] & s or marks[open_[at][1]][1] & c):
            at += 1
        if at < len(open_):
            residual, b = open_.pop(at)
        else:
            residual, b = capacity, len(marks)
            marks.append((0, 0))
        marks[b] = (marks[b][0] | s, marks[b][1] | c)
        bins[k] = b
        if residual > size:
            insort(open_, (residual - size, b))
    return bins


def _numbers(values: pa.Array) -> np.ndarray:
    """Small numbers for values that come twice; others and null have -1."""
    coded = np.array(values.dictionary_encode().indices.fill_null(-1), dtype=np.int64)
    often = np.bincount(coded + 1)
    often[0] = 0
    number = np.where(often > 1, np.cumsum(often > 1) - 1, -1)
    return number[coded + 1]


def _shard(rows: pa.RecordBatch, capacity: int) -> pa.RecordBatch:
    keys = [rows[c].to_numpy(zero_copy_only=False) for c in ("piece", "row", "n_tokens")]
    order = np.lexsort((keys[0], keys[1], -keys[2]))
    rows = rows.take(pa.array(order))
    bins = best_fit(rows["n_tokens"].to_numpy(), _numbers(rows["source"]), _numbers(rows["cluster"]), capacity)
    names = [c for c in rows.schema.names if c not in ("source", "cluster")]
    return pa.RecordBatch.from_arrays([*[rows[c] for c in names], pa.array(bins)], [*names, "bin"])


def near_clusters(docs: DataFrame, width: int = 5, least_percent: int = 80) -> DataFrame:
    """own and cluster, the text's hash and that of its near duplicates' least, for texts where they differ.

    Texts are named by their hash, so that null and repeated ids don't matter.
    """
    return _clusters(near_groups(docs.select(F.xxhash64("text").alias("own"), "text"), width, least_percent, doc_id="own"))


def _clusters(groups: DataFrame) -> DataFrame:
    return groups.where("not kept").select(F.col("doc_id").alias("own"), F.col("component_id").alias("cluster")).distinct()


def pack(docs: DataFrame, capacity: int = CAPACITY, by_source: bool = True, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, shard and bin of each piece of each row of ``docs``.

    Tokens are words. Null, empty and wordless texts have no piece. Texts that
    are equal, or that ``clusters`` (own, cluster) puts together by their
    xxhash64, make a duplicate cluster and never share a bin, nor do, with
    ``by_source``, two pieces of one source; null sources conflict with
    nothing. Rows that repeat a doc_id are documents of their own; further
    columns are not read. Pieces of equal size go by their row's hash. Bins
    are numbered within their shard. No rows give none.
    """
    kept = _named(docs, by_source).select("doc_id", "source", "own", word_count("text").alias("size"))
    return _packed(materialize(kept.where("size > 0")), capacity, clusters)


def pack_apart(docs: DataFrame, capacity: int = CAPACITY, by_source: bool = True, width: int = 5, least_percent: int = 80) -> DataFrame:
    """``pack`` of ``docs`` with their ``near_clusters``; one reading of the texts counts words and signs shingles."""
    named = _named(docs, by_source)
    signs = materialize(signed(named, width))
    texts = named.select(F.col("own").alias("doc_id"), "text")
    groups = grouped(signs.select(F.col("own").alias("doc_id"), "n_shingles", "fp", "sig"), texts, width, least_percent)
    sized = signs.where("n_words > 0").select("doc_id", "source", "own", F.col("n_words").alias("size"))
    return _packed(sized, capacity, _clusters(groups))


def _named(docs: DataFrame, by_source: bool) -> DataFrame:
    """doc_id, source (null unless ``by_source``), own (the text's hash) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("source") if by_source else F.lit(None).cast("string")).alias("source"), F.xxhash64("text").alias("own"), "text")


def _packed(sized: DataFrame, capacity: int, clusters: DataFrame | None) -> DataFrame:
    """The pieces of ``sized`` (doc_id, source, own, size), which is already written, in their bins."""
    rows, pieces = sized.agg(F.count("*"), F.coalesce(F.sum(F.ceil(F.col("size") / capacity)), F.lit(0))).first()
    shards = max(1, -(-pieces // SHARD_PIECES))
    # Each text's hash with its cluster; a text that many rows have is joined by broadcast.
    texts = sized.groupBy("own").agg(F.count("*").alias("n"))
    texts = texts.join(clusters, "own", "left") if clusters is not None else texts.withColumn("cluster", F.col("own"))
    placed = join_hot(sized, materialize(texts.select("own", "n", F.coalesce("cluster", "own").alias("cluster"))), "own", "n", rows)
    # A piece's shard follows from its own row and which copy of it this is, so equal rows spread over all shards.
    alike = placed.groupBy("doc_id", "source", "own", "cluster", "size").agg(F.count("*").alias("n"))
    few = alike.where(F.col("n") <= LOT).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    lots = alike.where(F.col("n") > LOT).withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / LOT)))).repartition("doc_id", "own", "lot")
    many = lots.withColumn("copy", F.explode(F.sequence(F.col("lot") * LOT, F.least((F.col("lot") + 1) * LOT, "n") - 1))).drop("lot")
    numbered = few.unionByName(many).withColumn("row", F.xxhash64("doc_id", "own", "size", "copy"))
    cut = numbered.select("doc_id", "row", "source", "cluster", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    cut = cut.select("doc_id", "row", "source", "cluster", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("size") - start).cast("long").alias("n_tokens"), F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
    return by_group(cut, ["shard"], lambda rows: _shard(rows, capacity), "doc_id long, row long, piece int, start long, n_tokens long, shard long, bin long", 64 * pieces).drop("row")
