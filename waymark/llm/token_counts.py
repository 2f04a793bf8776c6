"""Token counts as rollups that signed deltas maintain.

A batch is a set of signed document counts: inserts add, deletes subtract, and
a revised count is a delete of the old and an insert of the new.  A commit
aggregates a batch by source, language and tokenizer version and writes it as
the partition of its batch id in one rename; an id that is committed already is
left as it is, so replays change nothing.  Totals are the
sum over the committed batches, which stays additive under any order.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import shared_folder, slices

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Texts are encoded in pieces cut after white space near this many characters, which bounds memory.
PIECE = 1 << 16


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/waymark-{spark.sparkContext.applicationId}/rollup-{uuid.uuid4().hex}"

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Commit signed rows (source, lang, tokenizer, docs, tokens); a batch id counts once however often it is committed."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"not a batch id: {batch!r}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{x}")
        files = path("").getFileSystem(conf)
        if files.exists(path(f"batch={batch}")):
            return
        staged = f"_staged-{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.select(*KEYS, *[F.col(c).cast("long") for c in SUMS]).write.parquet(f"{self.folder}/{staged}")
        # The rename makes all of the batch visible at once, or, after a failure, nothing of it.
        if not files.rename(path(staged), path(f"batch={batch}")) and not files.exists(path(f"batch={batch}")):
            raise OSError(f"batch {batch} could not be committed")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; groups that came to nothing are left out."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = top.getFileSystem(conf)
        found = [s.getPath().toString() for s in files.listStatus(top) if s.getPath().getName().startswith("batch=")] if files.exists(top) else []
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        batches = self.spark.read.schema(SCHEMA).parquet(*found)
        return batches.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("docs <> 0 or tokens <> 0")


def _pieces(text: str) -> Iterator[str]:
    """Cut a long text before a blank that ends a word, where the tokenizer's words end too."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace() and cut + 1 < len(text) and not text[cut + 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_counts(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` without ``text`` and with the number of tokens of each whole text.

    Null and empty texts have none; very long ones are encoded in pieces that
    count as the whole. Rows are counted each, repeated or not. No rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        for batch in slices(batches, text):
            sizes = [sum(len(encoding.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(sizes, pa.int64())], [*kept, out])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{fields}, `{out}` long")


def deltas(counted: DataFrame, version: str, sign: int | Column, tokens: str = "tokens") -> DataFrame:
    """Signed rows of counted documents: +1 inserts, -1 deletes. Null sources and languages are groups of their own."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    return counted.select("source", "lang", F.lit(version).alias("tokenizer"), sign.cast("long").alias("docs"), (sign * F.col(tokens)).cast("long").alias("tokens"))
