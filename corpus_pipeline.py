"""The corpus pipeline: documents in, a deduplicated, clean, weighted and sharded corpus out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame; it is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of documents. ``run`` applies them to the documents of a folder. Every stage
handles whole texts in small batches, also when its frame is run later, unless the session sets the sizes itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestkit.llm import decontaminate, language, mixing, ngram_join, sharding
from ingestkit.llm.common import WORD, free_name, small_batches, written

#: A text is rejected that has no letter, or whose words no language has two fifths of: short texts with a key or a number
#: in them stay.
LEAST_SCORE = 0.4

#: Near duplicates share four fifths of their runs of five words; op1_ngram_join has a measure of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: ``und`` and texts with less than ``LEAST_SCORE`` of their probability on one language go."""
    small_batches(spark)
    judged = language.identify(docs, spans=False)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of every group one row stays, that with the smallest id if there is one. Rows are told apart by
    their texts, so ids may repeat or be null; rows without words stay, once for an id and text."""
    small_batches(spark)
    row = free_name(docs, "_row")
    named = F.concat(F.coalesce(F.sha2(F.col("doc_id").cast("string"), 256), F.lit("")), F.sha2("text", 256))
    rows = docs.withColumn(row, F.unhex(F.sha2(named, 256)))  # of id and text: whole texts meet the winners in one exchange
    classes = ngram_join.join(rows, words=NEAR_WORDS, percent=NEAR_PERCENT, own_col=row).where("component IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_key", "own")).alias("first")
    winners = written(classes.groupBy("component").agg(first).select(F.col("first.own").alias(row)), "winners")
    words = F.coalesce("text", F.lit("")).rlike(WORD)
    kept = rows.where(words).join(winners, row, "left_semi").dropDuplicates([row]).drop(row)
    wordless = docs.where(~words)
    once = wordless.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return kept.unionByName(once).unionByName(wordless.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents of which a twentieth or more is benchmark text go."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).where(~F.col("contaminated")).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as the mix takes it, in shuffled order."""
    small_batches(spark)
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: where every row of the mix goes."""
    small_batches(spark)
    return sharding.shard_rows(docs)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learned labels and bounded loads have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
