"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

All but the last return the columns of documents, whatever these are called.
Each stage is written and read again before the next. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import language_id, mixing, near_dedup, packing, toxicity
from waymark.llm.common import free_name, materialize

#: A document goes as toxic from this score on.
TOXIC_SCORE = 0.7
#: A document goes whose language is undetermined or less probable than this.
LEAST_POSTERIOR = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are scored as toxic.

    Each row is judged by its own text, in whole: null and empty texts stay,
    repeated rows go or stay together, and a toxic passage rejects a text of
    any length. Without labels of both kinds all rows stay.
    """
    score = free_name(docs, "score")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, model, score).where(F.col(score) < TOXIC_SCORE).drop(score)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no determined language.

    Text, the declared language and the source's other documents decide; a null
    of any of them says nothing. Null and empty texts go by the other evidence,
    repeated rows are judged each, and ties go to the first language by name.
    """
    judged = language_id.document_languages(docs, language_id.fit(docs), docs.columns)
    return judged.where((F.col("language") != "und") & (F.col("posterior") >= LEAST_POSTERIOR)).select("kept.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id: five words a shingle, similarity of 0.8 or more.

    Null, empty and wordless texts stay. Of rows that agree in doc_id and
    shingles one stays; null ids take part and stay only in a group without
    others.
    """
    return near_dedup.one_of_each(docs, width=5, least_percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its taken words fill it, 0 to 2 times; the fraction is rounded by a seeded hash.

    Null, empty and wordless texts have nothing to take, so they go. Rows that
    agree in doc_id and text are taken alike, null ids and sources like others.
    """
    own, copies = free_name(docs, "own"), free_name(docs, "copies")
    taken = mixing.mix(docs, with_own=True).where("size > 0")
    # Uniform in [0, 1) by document, so that the copies come to the taken words on the whole.
    fraction = F.pmod(F.xxhash64(F.lit(23), "doc_id", "own"), F.lit(1 << 20)) / (1 << 20)
    times = F.floor(F.sum("taken") / F.sum("size") + fraction).cast("int")
    times = taken.groupBy("doc_id", "own").agg(times.alias("times")).where("times > 0").select(F.col("doc_id").alias("mixed_id"), F.col("own").alias("mixed_own"), "times")
    # A side with columns of its own only, so that no name of docs can clash.
    times = times.select(F.struct("*").alias(copies))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    mixed = hashed.join(times, (F.col(own) == F.col(f"{copies}.mixed_own")) & hashed["doc_id"].cast("long").eqNullSafe(F.col(f"{copies}.mixed_id")))
    return mixed.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(f"{copies}.times")))).select([F.col(f"`{c}`") for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; a row per piece.

    Null, empty and wordless texts have no piece. Equal texts and documents of
    one source share no bin; long texts are cut into pieces, and repeated rows
    are documents of their own.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language_id", keep_known_languages), ("near_dedup", drop_near_duplicates), ("mix_sources", mix_sources), ("pack", pack_documents)]

#: The stages learn models, link near duplicates and pack greedily, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
