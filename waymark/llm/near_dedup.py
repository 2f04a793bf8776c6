"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A signature is 32 symbols of 16 bits, cut into 8 chunks of 4.  If two
signatures differ in at most 15 symbols, some chunk differs in at most one
(pigeonhole: two errors in each of 8 chunks make 16).  Each chunk's allowed
errors are enumerated by leaving out one of its four symbols in turn, so every
pair within distance 15 shares one of 32 keys.  At a similarity of 0.8 all
eight chunks have two errors with probability 1e-6.

Pairs are never listed.  Texts with equal shingle sets collapse to one node.
The nodes of one key go to the group of the key's least node, so two nodes that
share a key share a group, and a node is in at most 32.  A group holds the full
shingle sets, counts all its intersections at once as products of an incidence
matrix, and gives one edge per linked node to its local component.  A group of
more than ``BLOCK`` nodes is dealt out as chunks, each with the group's least node:
whoever reaches that node within a chunk needs no more, and only the rest of
the nodes are held against all other chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import by_group, free_name, join_hot, map_text, materialize, slices, tidy
from waymark.llm.components import components, local_roots
from waymark.llm.shingles import counted_sets, minhash, mix, shingle_sets

CHUNK, CHUNKS = 4, 8
#: For each key of a signature the symbols of its chunk that count, and what tells it from the other keys.
_COUNT = np.array([~(0xFFFF << 16 * k) & 0xFFFFFFFFFFFFFFFF for k in range(CHUNK)], dtype=np.uint64)
_WHICH = np.random.default_rng(20240608).integers(0, 1 << 64, (CHUNKS, CHUNK), dtype=np.uint64)
#: Nodes of a group that are held against as many others in one task.
BLOCK = 512
#: Log2 of the bits that mark texts whose sets are wanted: 8 MB.
BITMAP = 26


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """64 bits of each set: a sum over its mixed members, mixed with its size."""
    sums = np.array([mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum() for s in sets], dtype=np.uint64)
    return mix(sums + np.array([len(s) for s in sets], dtype=np.uint64)).view(np.int64)


def _or_null(fps: np.ndarray, sets: list[np.ndarray]) -> pa.Array:
    """The fingerprints; null for empty sets."""
    return pa.array(fps, pa.int64(), mask=np.array([len(s) == 0 for s in sets], dtype=bool))


def with_fingerprint(docs: DataFrame, text: str, width: int, out: str) -> DataFrame:
    """``docs`` with the fingerprint of each text's shingle set; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = list(shingle_sets(batch[text], width))
            yield pa.RecordBatch.from_arrays([*batch.columns, _or_null(_fingerprints(sets), sets)], [*batch.schema.names, out])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def one_of_each(docs: DataFrame, width: int = 5, least_percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least doc_id.

    Texts without shingles stay. Of rows that agree in doc_id and shingles one
    stays; of a group without any doc_id, one of each shingle set.
    """
    fp, wanted = free_name(docs, "fp"), free_name(docs, "wanted")
    named = with_fingerprint(docs, "text", width, fp)
    kept = near_groups(docs, width, least_percent, with_fp=True).where("kept and fp is not null")
    kept = materialize(kept.groupBy("doc_id", "fp").agg((F.count("*") > 1).alias("again")))
    # One struct, so that no column of docs can have the name of a helper.
    kept = kept.select(F.struct(F.col("doc_id").alias("id"), "fp", "again").alias(wanted))
    same = (F.col(fp) == F.col(f"{wanted}.fp")) & named["doc_id"].cast("long").eqNullSafe(F.col(f"{wanted}.id"))
    again = F.col(f"{wanted}.again")
    out = named.where(F.col(fp).isNull()).unionByName(named.join(kept.where(~again), same, "left_semi"))
    if not kept.where(again).isEmpty():
        out = out.unionByName(named.join(kept.where(again), same, "left_semi").dropDuplicates(["doc_id", fp]))
    return out.drop(fp)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """The columns of ``docs`` but text, n_words, n_shingles, fp and sig (8 longs of four symbols; null, as fp, for an empty set)."""
    others = [c for c in docs.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, sets = counted_sets(batch["text"], width)
        sets = list(sets)
        sizes = pa.array([len(s) for s in sets], pa.int64())
        sigs = pa.array([minhash(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
        made = [pa.array(words, pa.int64()), sizes, _or_null(_fingerprints(sets), sets), sigs]
        return pa.RecordBatch.from_arrays([*[batch[c] for c in others], *made], [*others, "n_words", "n_shingles", "fp", "sig"])

    made = T.StructType.fromDDL("n_words long, n_shingles long, fp long, sig array<long>")
    return map_text(docs, "text", run, T.StructType([*[docs.schema[c] for c in others], *made]))


def _bitmap(values: DataFrame, value: Column) -> bytes:
    """2^``BITMAP`` bits, whatever the corpus, of which those of each ``value`` are set."""
    place = F.pmod(value, F.lit(1 << BITMAP)) + 1
    parts = values.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("at"))
    out = bytearray(1 << BITMAP - 3)
    for part, bits in parts.groupBy("part").agg(F.bitmap_construct_agg("at")).collect():
        out[(part - 1) * 4096 : part * 4096] = bits
    return bytes(out)


def _marked(bitmap: bytes, values: np.ndarray) -> np.ndarray:
    """Which of the values have their bit set."""
    place = values & ((1 << BITMAP) - 1)
    return (np.frombuffer(bitmap, dtype=np.uint8)[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _keyed(nodes: DataFrame, columns: str, bitmap: bytes | None = None) -> DataFrame:
    """The 32 keys of each node's sig, of which each long holds a chunk of four symbols; only those in ``bitmap``, if given."""
    shared = None if bitmap is None else nodes.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch["sig"].flatten().to_numpy().view(np.uint64).reshape(-1, CHUNKS, 1)
            key = mix(sig & _COUNT ^ _WHICH).view(np.int64).ravel()
            fp = np.repeat(batch["fp"].to_numpy(), CHUNKS * CHUNK)
            if shared is not None:
                some = np.flatnonzero(_marked(shared.value, key))
                key, fp = key[some], fp[some]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"]).select(columns.split())

    return nodes.select("fp", "sig").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in columns.split()))


def _members(nodes: DataFrame) -> DataFrame:
    """pivot and fp: for each node the least node of each key that it shares with others.

    Nearly all keys are of one node. A first pass over keys alone marks those
    that come again in a bitmap; only nodes of marked keys are shuffled, and
    those few that the bitmap lets through in vain are told by the exact count.
    """
    again = materialize(_keyed(nodes, "key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    keyed = materialize(_keyed(nodes, "key fp", _bitmap(again, F.col("key"))))
    buckets = materialize(keyed.groupBy("key").agg(F.min("fp").alias("pivot"), F.count("*").alias("n")).where("n > 1"))
    return join_hot(keyed, buckets, "key", "n", keyed.count()).select("pivot", "fp").distinct()


def _sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """fp and the shingle set of each of the ``wanted`` (fp, doc_id), and of few others; a fp may come again.

    The texts are read once more; a bitmap tells most of those that are not
    wanted, so that neither texts nor their sets need be shuffled here. It marks
    ids, so that of other texts no set is made, and sets together with their id.
    """
    own = F.coalesce("doc_id", F.lit(0))
    marks = wanted.select(F.explode(F.array(own, F.col("fp").bitwiseXOR(own))).alias("mark"))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(marks, F.col("mark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            ids = np.array(batch["doc_id"].fill_null(0), dtype=np.int64)
            asked = _marked(shared.value, ids)
            if not asked.any():
                continue
            found = list(shingle_sets(batch["text"].filter(pa.array(asked)), width))
            fps = _fingerprints(found)
            marked = _marked(shared.value, fps ^ ids[asked]) & np.array([len(s) > 0 for s in found])
            some = [k for k in np.flatnonzero(marked).tolist() if not (fps[k] in seen or seen.add(fps[k]))]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(fps[some]), pa.array([found[k].view(np.int64) for k in some], pa.list_(pa.int64()))], ["fp", "shingles"])

    return docs.mapInArrow(tidy(run), "fp long, shingles array<long>")


def _those(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``sets`` of the fp of ``wanted``, and few others, found without shuffling any."""
    shared = sets.sparkSession.sparkContext.broadcast(_bitmap(wanted, F.col("fp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = _marked(shared.value, batch["fp"].to_numpy())
            if marked.any():
                yield batch.filter(pa.array(marked))

    return sets.mapInArrow(tidy(run), sets.schema)


def _intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each two sets share, from products of at most ``columns`` shingles at a time."""
    size = np.array([len(s) for s in sets])
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, which, often = np.unique(token, return_inverse=True, return_counts=True)
    some = often[which.ravel()] > 1
    _, which = np.unique(which.ravel()[some], return_inverse=True)
    owner, which = owner[some], which.ravel()
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    for at in range(0, int(which[-1]) + 1 if len(which) else 0, columns):
        x, y = np.searchsorted(which, [at, at + columns])
        part = np.zeros((len(sets), columns), dtype=np.float32)
        part[owner[x:y], which[x:y] - at] = 1
        shared += part @ part.T
    # Sums of ones are exact in single precision up to 2^24 shingles in common; above that they are counted one by one.
    out = shared.astype(np.int64)
    for a, b in zip(*np.nonzero(np.triu(shared >= 1 << 24, 1)), strict=True):
        out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    np.fill_diagonal(out, size)
    return out


def _local(rows: pa.RecordBatch, least_percent: int) -> np.ndarray:
    """For each node of a group the place of the least that it reaches here."""
    column = rows["shingles"]
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    sets = [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    shared = _intersections(sets)
    linked = 100 * shared >= least_percent * (size[:, None] + size[None, :] - shared)
    np.fill_diagonal(linked, False)
    return local_roots(linked)


def _chunk(rows: pa.RecordBatch, least_percent: int) -> pa.RecordBatch | None:
    """An edge from each linked node of a chunk to the least it reaches here, and of a group of several chunks whether it reaches the pivot."""
    rows = rows.sort_by("fp")
    fp, root = rows["fp"].to_numpy(), _local(rows, least_percent)
    chunks, pivot = rows["chunks"][0].as_py(), rows["pivot"][0].as_py()
    # The pivot is the least of its group, so it is the first of each chunk.
    done = (root == 0) | (chunks == 1)
    some = np.flatnonzero((root != np.arange(len(fp))) | ~done)
    if not len(some):
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), pivot)), pa.array(fp[some]), pa.array(fp[root[some]]), pa.array(done[some])], ["pivot", "node", "root", "done"])


def _pair(rows: pa.RecordBatch, least_percent: int) -> pa.RecordBatch | None:
    """An edge from each linked node of a block and a chunk to the least it reaches here."""
    fp, root = rows["fp"].to_numpy(), _local(rows, least_percent)
    some = np.flatnonzero(root != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(fp[root[some]])], ["node", "root"]) if len(some) else None


def _edges(members: DataFrame, sets: DataFrame, least_percent: int, size: int) -> DataFrame:
    """(node, root): edges that join the nodes of each group (pivot, fp) as its links do."""
    dealt = materialize(members.groupBy("pivot").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")))
    total = members.count()
    named = join_hot(members, dealt, "pivot", "n", total).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    named = materialize(named)
    pivots = dealt.where("chunks > 1").select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks", F.col("pivot").alias("fp"))
    rows = named.where("chunks = 1 or fp <> pivot").select("pivot", "chunk", "chunks", "fp").unionByName(pivots.select("pivot", "chunk", "chunks", "fp"))
    # One shuffle by fp serves to leave one set of each and to join.
    first = materialize(by_group(rows.join(sets.dropDuplicates(["fp"]), "fp"), ["pivot", "chunk"], lambda r: _chunk(r, least_percent), "pivot long, node long, root long, done boolean", size))
    edges = first.where("node <> root").select("node", "root")
    left = first.where("not done").select("pivot", F.col("node").alias("fp"))
    if left.isEmpty():
        return edges
    # Those that don't reach the pivot, in blocks, against all chunks of their group.
    blocks = left.groupBy("pivot").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = materialize(blocks.join(dealt.select("pivot", "chunks"), "pivot"))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asking = join_hot(left, blocks, "pivot", "n", left.count())
    asking = asking.select("pivot", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), span("chunks").alias("chunk"), "fp")
    asked = join_hot(named.select("pivot", "chunk", "fp"), blocks.select("pivot", "blocks").join(dealt.select("pivot", "n"), "pivot"), "pivot", "n", total)
    asked = asked.select("pivot", span("blocks").alias("block"), "chunk", "fp")
    met = materialize(asking.unionByName(asked).distinct())
    met = met.join(_those(sets, met).dropDuplicates(["fp"]), "fp")
    return edges.unionByName(by_group(met, ["pivot", "block", "chunk"], lambda r: _pair(r, least_percent), "node long, root long", size))


def near_groups(docs: DataFrame, width: int = 5, least_percent: int = 80, doc_id: str = "doc_id", text: str = "text", with_fp: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    component_id is the least doc_id of the texts reachable by links, kept tells
    whether it is the row's own. Rows that repeat a doc_id are texts of their
    own: each gets a row. Null doc_ids take part, but are never a
    component_id unless a whole component has no other. Null, empty and
    wordless texts have no shingles, are linked with nothing and kept. Other
    columns of ``docs`` are not read, whatever their names. No rows give none.
    ``with_fp`` puts the set's fingerprint before the other columns.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return grouped(materialize(signed(docs, width)), docs, width, least_percent, with_fp)


def grouped(signs: DataFrame, docs: DataFrame, width: int, least_percent: int, with_fp: bool = False) -> DataFrame:
    """What ``near_groups`` gives, for doc_id and text of ``docs``, of which ``signs``, already written, are ``signed``."""
    nodes = signs.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    nodes = materialize(nodes)
    n_docs, n_nodes = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    members = materialize(_members(nodes))
    wanted = materialize(nodes.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", "doc_id", "n_shingles"))
    sets = materialize(_sets(docs, width, wanted.select("fp", "doc_id")))
    # A node is in several groups; so is its set.
    size = 8 * (members.join(wanted.select("fp", "n_shingles"), "fp").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0])
    comps = materialize(components(_edges(members, sets, least_percent, size), "node", "root"))

    rooted = nodes.select("fp", "doc_id", "n").join(comps, nodes["fp"] == comps["node"], "left").select("fp", "doc_id", "n", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_nodes"))
    named = join_hot(rooted, least, "root", "n_nodes", n_nodes).select("fp", "component_id", "n")
    out = signs.select("doc_id", "n_shingles", "fp")
    linked = join_hot(out.where("fp is not null"), materialize(named), "fp", "n", n_docs)
    alone = out.where("fp is null").withColumn("component_id", F.col("doc_id"))
    out = linked.unionByName(alone)
    return out.select(*["fp"] * with_fp, "doc_id", "n_shingles", "component_id", F.equal_null("doc_id", "component_id").alias("kept"))
