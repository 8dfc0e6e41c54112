"""Corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes all documents that its predecessor kept.  All but the last
return the columns of documents; rows with a null id pass the stages that decide
by id, and an empty table passes all stages; further columns of any name pass too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import decontaminate, jaccard, packing, quality, secrets
from stopwise.llm.common import stash

#: Documents with a score under this go.
LEAST_QUALITY = 0.5
#: Ids of at most so many documents that go are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labels of rows with crc32(doc_id) mod 3 other than 1."""
    learned = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False)))
    model = quality.fit(learned, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    return quality.score(whole, model, "row.text").where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 of their 5-word shingles: the smallest id's.

    Rows that share an id and a text are copies; rows that share an id alone are
    documents of their own.  Rows with a null id stay.
    """
    placed = stash(jaccard.jaccard_join(docs, 5, 80, 100).select("doc_id", "key", "component_key"))
    first = placed.groupBy("component_key").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = stash(placed.join(first, "component_key").where(F.struct("doc_id", "key") != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct())
    repeated = not placed.groupBy("doc_id").count().where("count > 1").isEmpty()
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    own = jaccard.document_key(F.col("doc_id"), F.col("text")) if repeated else F.col("doc_id")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = whole.join(F.broadcast(gone) if few else gone, (F.col("doc_id") == F.col("_id")) & (own == F.col("_key")), "left_anti")
    if repeated:
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))
    return kept.select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a shorter item whole."""
    rest = [c for c in docs.columns if c != "text"]
    split = docs.select("doc_id", "text", F.struct(*rest).alias("rest"))
    clean = decontaminate.hits(split, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, 5, keep=("text", "rest")).where("n_hit = 0")
    return clean.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all remaining documents into sequences of 1024 tokens."""
    return packing.pack(docs, limit=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokeniser have no SQL form; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
