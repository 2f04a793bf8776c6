"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets follow the weights, and no source gives more than ``most`` times its
size (the excess is shared by weight among the rest, in closed form).  Blocks of
equal numbers of words are apportioned to sources by highest quotients, and
each source's blocks to its shards in the same way.  A shard's documents, in
the order of a seeded hash, make a stream that is cut into equal blocks; a
seeded systematic choice takes exactly the shard's quota of them.  How many of
the blocks before any place are taken is one division, so blocks are never
listed, and no task holds more than a shard's (id, hash, size) rows.

Blocks and shards have the same words at every size of the input.  Sources and
the shards of one source are rows of one task each: a shard of 4 Mi words is
some 25 MB of text, so a source of 100 TB has 4 million of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waymark.llm.common import materialize, word_count

#: Words of a block, and of a shard, about.
BLOCK_WORDS, SHARD_WORDS = 16, 1 << 22


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1), at most ``caps`` each; ties go to the first."""
    votes, caps = np.asarray(votes, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    if seats <= 0 or votes.sum() <= 0:
        return np.zeros(len(votes), dtype=np.int64)
    # Rounding at the mean divisor is an apportionment of nearly as many seats; the last ones are moved by quotient.
    out = np.minimum(np.floor(votes * (seats / votes.sum()) + 0.5).astype(np.int64), caps)
    over = [(votes[i] / (2 * out[i] - 1), -i) for i in range(len(votes)) if out[i] > 0]
    heapq.heapify(over)
    total = int(out.sum())
    while total > seats:
        _, i = heapq.heappop(over)
        out[-i] -= 1
        total -= 1
        if out[-i] > 0:
            heapq.heappush(over, (votes[-i] / (2 * out[-i] - 1), i))
    under = [(-votes[i] / (2 * out[i] + 1), i) for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0]
    heapq.heapify(under)
    while total < seats:
        _, i = heapq.heappop(under)
        out[i] += 1
        total += 1
        if out[i] < caps[i]:
            heapq.heappush(under, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with sid, their place, and target."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("sid", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    level = weighed.withColumn("level", left / rest)
    # The first source, by cap against weight, that its level doesn't fill sets the level of all that follow.
    final = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(everything)["level"]
    return level.withColumn("target", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap")))).drop("weight", "cap", "level")


def _taken_before(at: Column) -> Column:
    """Words that a shard's choice takes of its first ``at`` words.

    A shard of n blocks with quota q and start u takes block k as often as
    ((k + 1) q + u) div n exceeds (k q + u) div n, which is q times in all.
    """
    q, n, u, size = (F.col(c) for c in ("q", "n", "u", "block"))
    before = lambda k: F.floor((k * q + u) / n)
    k = F.floor(at / size)
    return (size * before(k) + (at - size * k) * (before(k + 1) - before(k))).cast("long")


def _quotas(planned: DataFrame, key: list[str], votes: str, seats: str, cap: str) -> DataFrame:
    """``planned`` with q, the apportionment of each group's ``seats``; a group is one row per source or shard."""

    def apportion(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sid", "shard"])
        return rows.assign(q=sainte_lague(rows[votes].to_numpy(), int(rows[seats].iloc[0]), rows[cap].to_numpy()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in planned.schema.fields if f.name != "q")
    return planned.drop("q").groupBy(*key).applyInPandas(apportion, f"{schema}, q long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, text: str = "text", with_own: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row; ``with_own`` puts the text's xxhash64 first, as ``own``.

    Sources in order of code points, null last, have the weights in turn. A
    document's taken words are at most ``most`` times its own; a source's come
    within two blocks a shard of its target. Null and empty texts have size 0
    and give nothing. Repeated rows are documents of their own; rows of one id,
    or without one, go to shards by their texts too. Equal inputs give equal
    results, however they are partitioned: rows that tie are alike. Further
    columns are not read. No rows give none.
    """
    sized = materialize(docs.select(F.xxhash64(text).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(text).alias("size")))
    block, shard_words = BLOCK_WORDS, SHARD_WORDS

    sources = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int"))
    sources = sources.withColumn("shard", F.lit(0)).withColumn("group", F.lit(0)).withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    sources = sources.withColumn("cap", F.ceil(F.col("source_size") / block) * int(most))
    sources = materialize(_quotas(sources, ["group"], "target", "seats", "cap").select(F.col("source").alias("of"), "sid", "source_size", "target", "shards", F.col("q").alias("source_q")))

    placed = sized.join(sources, sized["source"].eqNullSafe(sources["of"])).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "own"), F.col("shards")).cast("int"))
    shards = placed.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("source_q").alias("source_q"))
    shards = shards.withColumn("n", F.ceil(F.col("words") / block)).withColumn("cap", F.col("n") * int(most))
    shards = _quotas(shards, ["sid"], "words", "source_q", "cap").select("sid", "shard", "n", "q")
    shards = shards.withColumn("u", F.when(F.col("n") > 0, F.pmod(F.xxhash64(F.lit(seed), "sid", "shard"), F.col("n"))).otherwise(0)).withColumn("block", F.lit(block).cast("long"))
    order = W.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "own"), "doc_id", "own", "size").rowsBetween(W.unboundedPreceding, 0)
    ends = placed.join(shards, ["sid", "shard"]).withColumn("end", F.sum("size").over(order))
    taken = F.when(F.col("size") > 0, _taken_before(F.col("end")) - _taken_before(F.col("end") - F.col("size"))).otherwise(0).cast("long")
    return ends.select(*["own"] * with_own, "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"))
