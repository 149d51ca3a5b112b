"""The corpus pipeline: five stages over documents, each a thin use of one operator.

All stages but the last return the columns of documents; other columns go, whatever their names. Decisions are by doc_id:
rows that share one go or stay together (line dedup judges each by its own lines), and a row with a null id is only
changed by line dedup. Null texts count as empty: they stay until line dedup, which makes them empty texts. Ties go to the
smallest id. An empty table passes through every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearc.llm import encoding
from tonearc.llm.common import few_enough, saved, shuffled
from tonearc.llm.decontamination import contaminated
from tonearc.llm.line_dedup import dedup_lines
from tonearc.llm.ngram_join import near_duplicates
from tonearc.llm.packing import pack
from tonearc.llm.toxicity import score_toxicity

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs without the ids of lost (distinct ids); a null id is never lost. Ids whose hash table is small are broadcast to
    the documents, more are joined by a shuffle."""
    lost = saved(lost.select("doc_id").distinct(), "lost-ids")
    few = few_enough(lost.count(), 24)
    return docs.join(F.broadcast(lost) if few else shuffled(lost), "doc_id", "left_anti").select(*_COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, score_toxicity(docs, labels, threshold=0.3).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for their first place; documents all of whose lines went go with them."""
    left = dedup_lines(docs, carry=("lang", "source")).where(F.col("n_dropped") < F.col("n_lines"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays."""
    found = near_duplicates(docs, threshold=0.6, n=3, trees=40, recall=0.99)
    return _without(docs, found.where(F.col("doc_id") != F.col("group_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training sequences."""
    return pack(docs, encoding.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicate", near_duplicate), ("decontamination", decontamination), ("packing", packing)]

#: Tokenisation and similarity groups are beyond SQL. A test compares the ids that line dedup and near duplicates leave with
#: a brute-force version; toxicity, decontamination and packing are compared operator by operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
