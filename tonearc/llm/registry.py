"""The ten queries on the driver's tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonearc.llm import encoding, license_scan, line_dedup, toxicity, warc
from tonearc.llm.decontamination import contaminated
from tonearc.llm.fingerprints import fingerprints
from tonearc.llm.ngram_join import near_duplicates
from tonearc.llm.packing import pack
from tonearc.llm.token_counts import token_counts
from tonearc.llm.token_files import read_token_files, write_token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.write_index(warc.write_archives(pages, least=0))
    found = warc.lookup(index, warc.page_keys(pages))
    return warc.read_records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), encoding.path("byte_bpe_50k.json"), limit=1024)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.6, n=3, trees=40, recall=0.99)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), encoding.path("word_bpe_49k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), encoding.path("byte_bpe_50k.json"))
    return read_token_files(manifest)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    held_out = (toxicity.fold(out.doc_id) == 2).alias("held_out")
    return out.select("doc_id", held_out, "score", "predicted", "mean_ratio", "most", "large")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_token_counts, op3_decontamination, op4_ngram_join, op5_license_scan, op6_line_dedup, op7_fingerprints, op8_packing, op9_token_files, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op6_line_dedup": line_dedup.ORACLE}
