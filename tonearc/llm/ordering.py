"""Documents in ascending id order, each with the one after it, without one task seeing more than its stretch."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearc.llm import common as C


def with_next(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """work() gets batches (doc_id, text, next: the text of the next id; after the last, the first) and gives rows.

    Ids are cut into stretches at quantiles; a stretch is sorted in its own partition. The first document of each
    stretch also goes, marked, to the stretch before it, which is the one document more that its last row needs. Rows
    that share an id follow each other in the order of their texts; null ids come first."""
    spark = docs.sparkSession
    parts = C.partitions(spark)
    named = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("order"))
    points = named.agg(F.percentile_approx("order", [i / parts for i in range(1, parts)], 10000)).first()[0] if parts > 1 else []
    splits = [-math.inf, *sorted({float(p) for p in points or []}), math.inf]
    if len(splits) > 2:  # binary search by row; doubles keep the order of ids, which is all that counts
        placed = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(named.withColumn("place", F.col("order").cast("double"))).select("doc_id", "text", "order", F.col("bucket").cast("int").alias("part"))
    else:
        placed = named.withColumn("part", F.lit(0))
    firsts = sorted((r["part"], r["first"]) for r in placed.groupBy("part").agg(F.min("order").alias("first")).collect())  # a row per stretch
    if not firsts:
        return docs.select("doc_id", "text", F.col("text").alias("next")).mapInArrow(lambda b: (work(x) for x in b), schema)
    # The first row of a stretch among rows of one id is settled by its text.
    heads = placed.where(F.col("order").isin([first for _, first in firsts])).groupBy("order").agg(F.min("text").alias("text"))
    back = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "order long, part int")
    guests = heads.join(F.broadcast(back), "order").select(F.lit(None).cast("long").alias("doc_id"), "text", "order", "part", F.lit(True).alias("guest"))
    rows = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    spread = rows.repartitionById(len(splits) - 1, "part").sortWithinPartitions("guest", "order", "text").select("doc_id", "text", "guest")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for step in C.text_steps(batches):
            both = step if held is None else pa.Table.from_batches([held, step]).combine_chunks().to_batches()[0]
            n = both.num_rows - 1
            if n:
                now = both.slice(0, n)
                yield work(pa.RecordBatch.from_arrays([now.column("doc_id"), now.column("text"), both.column("text").slice(1, n)], ["doc_id", "text", "next"]))
            held = both.slice(n, 1)

    return spread.mapInArrow(walk, schema)
