"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables.

Equal vectors of one label collapse to a node that knows how many there are.
Each node goes to one bucket per table; within a bucket all cosines are one
matrix product, taken in double precision on the vectors themselves.  A pair
that meets in several tables counts in the first of them, which both nodes'
codes tell, so no pair ever leaves its bucket: a bucket gives each node's
number of links and one edge to its local component.  Buckets of more than
``BLOCK`` nodes are dealt out as pairs of blocks.

Buckets are dealt out by codes alone; each vector is then fetched once and sent
to those of its buckets that hold another node.  Bits and tables follow from
the number of nodes: enough bits for buckets of about ``BUCKET`` nodes, and
enough tables that a pair just at the threshold is missed with probability
``MISS`` at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import by_group, join_hot, materialize
from waymark.llm.components import components, local_roots

BLOCK, BUCKET = 1024, 256
MISS = 1e-6
_SEED = 8191


def shape_of(nodes: int, cosine: float) -> tuple[int, int]:
    """(bits, tables) for so many nodes."""
    bits = min(24, max(6, math.ceil(math.log2(max(nodes, 1) / BUCKET + 1))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _code_type(bits: int) -> np.dtype:
    return np.dtype("u1") if bits <= 8 else np.dtype("<u2") if bits <= 16 else np.dtype("<u4")


def _codes(packed: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), dtype=_code_type(bits)).reshape(len(packed), -1)


def _coded(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``nodes`` with ``codes``, the packed numbers of the node's bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            sizes = batch["dim"].to_numpy()
            codes = np.zeros((len(sizes), tables), dtype=np.int64)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([_SEED, dim]).standard_normal((dim, bits * tables))
                signs = _matrix(batch["embedding"].take(pa.array(at))) @ planes[dim] > 0
                codes[at] = signs.reshape(len(at), tables, bits) @ weight
            packed = [row.tobytes() for row in codes.astype(_code_type(bits))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], [*batch.schema.names, "codes"])

    return nodes.mapInArrow(run, T.StructType([*nodes.schema.fields, T.StructField("codes", T.BinaryType())]))


def _buckets(coded: DataFrame, bits: int) -> DataFrame:
    """A row per node and table: node, label, dim, table, code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(batch["codes"], bits)
            n, tables = codes.shape
            at = pa.array(np.repeat(np.arange(n), tables))
            columns = [*[batch[c].take(at) for c in ("node", "label", "dim")], pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(codes.ravel().astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "label", "dim", "table", "code"])

    fields = [coded.schema[c] for c in ("node", "label", "dim")]
    return coded.select("node", "label", "dim", "codes").mapInArrow(run, T.StructType([*fields, T.StructField("table", T.IntegerType()), T.StructField("code", T.LongType())]))


def block_pairs(df: DataFrame, node: str, size: str, block: int) -> DataFrame:
    """Deal groups of ``size`` rows out as pairs (i, j) of blocks; ``own`` is a row's block.

    Any two rows of a group meet in exactly one pair of blocks, or, of one
    block, in all that have it.
    """
    k = F.ceil(F.col(size) / block).cast("int")
    rows = df.withColumn("own", F.pmod(F.hash(node), k)).withColumn("other_block", F.explode(F.sequence(F.lit(0), k - 1)))
    return rows.withColumn("i", F.least("own", "other_block")).withColumn("j", F.greatest("own", "other_block")).drop("other_block")


def _bucket(rows: pa.RecordBatch, cosine: float, bits: int) -> pa.RecordBatch | None:
    """Links of one bucket, or of one pair of its blocks."""
    if len(rows) < 2:
        return None
    rows = rows.sort_by("node")
    table, i, j = (rows[c][0].as_py() for c in ("table", "i", "j"))
    unit, block = _unit(_matrix(rows["embedding"])), rows["own"].to_numpy()
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    if i != j:
        near &= block[:, None] != block[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return None
    codes, copies = _codes(rows["codes"], bits)[:, :table], rows["copies"].to_numpy()
    links = np.zeros(len(rows), dtype=np.int64)
    for at in range(0, len(a), 1 << 18):
        x, y = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
        first = ~(codes[x] == codes[y]).any(axis=1)
        np.add.at(links, x[first], copies[y[first]])
    node, some = rows["node"].to_numpy(), np.flatnonzero(near.any(axis=1))
    root = local_roots(near)
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some])], ["node", "other", "links"])


def near_vectors(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Only vectors of equal, non-null labels and equal lengths are compared.
    A vector that is null, empty, zero or has null, NaN or infinite components
    is linked with nothing and kept. Rows that repeat a vec_id are vectors of
    their own and links to them count each; a null vec_id takes part and is
    never a component_id unless its component has no other. Further columns
    are not read. No rows give none.
    """
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{label}`").alias("label"))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # -0.0 equals 0.0, so it must not set equal vectors apart.
    even = F.transform("embedding", lambda x: x + F.lit(0).cast(v.schema["embedding"].dataType.elementType))
    v = v.withColumn("node", F.when(sound, F.xxhash64("label", even)))
    nodes = v.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = materialize(nodes.withColumn("dim", F.size("embedding")))
    n_nodes = nodes.count()
    bits, tables = shape_of(n_nodes, cosine)

    coded = materialize(_coded(nodes.drop("vec_id"), bits, tables))
    bucket = ["label", "dim", "table", "code"]
    placed = _buckets(coded, bits).withColumn("bucket", F.struct(*bucket))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("members", F.col("n"))
    placed = join_hot(placed.select("node", "bucket"), sizes, "bucket", "n", n_nodes * tables)
    placed = block_pairs(placed, "node", "members", BLOCK).select("node", "bucket.*", "own", "i", "j")
    met = placed.join(coded.select("node", "copies", "embedding", "codes"), "node")
    size = n_nodes * tables * 4 * (coded.agg(F.coalesce(F.max("dim"), F.lit(0))).first()[0] + 16)
    found = materialize(by_group(met, [*bucket, "i", "j"], lambda rows: _bucket(rows, cosine, bits), "node long, other long, links long", size))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found, "node", "other").withColumnRenamed("node", "member")
    rooted = materialize(nodes.select("node", "vec_id", "copies").join(comps, F.col("node") == F.col("member"), "left").select("node", "vec_id", "copies", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component"), F.count("*").alias("n"))
    named = join_hot(rooted, least, "root", "n", n_nodes).join(counts, "node", "left")
    named = materialize(named.select("node", "component", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    v = v.select("vec_id", "node")
    linked = join_hot(v.where("node is not null"), named, "node", "copies", v.count())
    alone = v.where("node is null").select("node", "vec_id", F.col("vec_id").alias("component"), F.lit(0).alias("links"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.equal_null("vec_id", "component").alias("kept"))
