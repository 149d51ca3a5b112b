"""Calendar series of sentiment and topic proportions: aggregation, gap filling, rolling, scaling.

Series are long: (date, [topic,] value). Rolling happens before scaling, on the gap-filled calendar; only periods that
had data stay. Means and standard deviations that scale a series also scale the documents' sentiment.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearc.model import TopicModel
from tonearc.operators import posterior as P
from tonearc.operators.sentiment import document_sentiment, topic_sentiment
from tonearc.operators.summary import _label

PERIODS = {"day": "interval 1 day", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}
ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "sd": F.stddev_samp}


def _rolled(fun: str, frame: Window) -> Column:
    """A function of value over a frame; the median has no frames of its own: it is taken of the frame's few values."""
    if fun != "median":
        return ROLLING[fun](F.col("value")).over(frame)
    own = F.array_sort(F.collect_list("value").over(frame))
    n = F.size(own)
    return F.when(n > 0, (F.element_at(own, F.floor((n + 1) / 2).cast("int")) + F.element_at(own, F.floor(n / 2).cast("int") + 1)) / 2)


def floor_date(date: Column, period: str) -> Column:
    if period not in PERIODS:
        raise ValueError(period)
    return F.date_trunc(period, date).cast("date")


def roll(series: DataFrame, period: str, window: int, by: list[str] | None = None, fun: str = "mean", align: str = "right", complete: bool = True) -> DataFrame:
    """value rolled over `window` periods of the whole calendar between the first and the last date. Nulls are left out;
    periods without a full window are null; periods without data go."""
    by = by or []
    if window <= 1:
        return series
    ends = series.agg(F.min("date").alias("a"), F.max("date").alias("z"))
    calendar = ends.select(F.explode(F.expr(f"sequence(a, z, {PERIODS[period]})")).alias("date"))
    if by:
        keys = series.select(*by).distinct().agg(F.collect_set(F.struct(*by)).alias("k"))  # topics of the model
        calendar = calendar.join(F.broadcast(keys)).select("date", F.explode("k").alias("k")).select("date", "k.*")
    filled = calendar.join(series, ["date", *by], "left")
    before = {"right": window - 1, "left": 0, "center": window // 2}[align]
    if complete and align == "center" and window % 2 == 0:
        before = window // 2 - 1
    order = Window.partitionBy(*by).orderBy("date") if by else Window.orderBy("date")
    frame = order.rowsBetween(-before, window - 1 - before)
    rolled = F.when(F.count(F.lit(1)).over(frame) == window, _rolled(fun, frame))
    return filled.withColumn("_rolled", rolled).where(F.col("value").isNotNull()).withColumn("value", F.col("_rolled")).drop("_rolled")


def scaling(series: DataFrame, start: str | None = None, end: str | None = None) -> tuple[float, float]:
    """Mean and sample standard deviation over the scaling period, both ends included."""
    own = series.where(F.col("value").isNotNull())
    if start is not None:
        own = own.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        own = own.where(F.col("date") <= F.lit(end).cast("date"))
    row = own.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if row.n < 2:
        raise ValueError("scaling needs two dates or more")
    return row.m, row.s


def _dated(m: TopicModel, sentiment: DataFrame) -> DataFrame:
    return m.dates().where(F.col("date").isNotNull()).join(sentiment, "doc_id")


def sentiment_series(m: TopicModel, period: str = "year", rolling: int = 1, scale: bool = True, scaling_period: tuple[str, str] | None = None, fun: str = "mean", align: str = "right") -> DataFrame:
    """(date, value): mean document sentiment by period."""
    means = _dated(m, document_sentiment(m)).groupBy(floor_date(F.col("date"), period).alias("date")).agg(F.avg("sentiment").alias("value"))
    out = roll(means, period, rolling, fun=fun, align=align)
    if not scale:
        return out
    mean, sd = scaling(out, *(scaling_period or ()))
    return out.withColumn("value", (F.col("value") - mean) / sd)


def scaled_sentiment(m: TopicModel, period: str = "year", rolling: int = 1, scaling_period: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, sentiment): document sentiment by the mean and deviation of the series."""
    mean, sd = scaling(sentiment_series(m, period, rolling, scale=False), *(scaling_period or ()))
    return document_sentiment(m).withColumn("sentiment", (F.col("sentiment") - mean) / sd)


def scaled_topic_sentiment(m: TopicModel, period: str = "year", rolling: int = 1, scaling_period: tuple[str, str] | None = None, method: str = "proportional") -> DataFrame:
    """(doc_id, topic, s): topics' own sentiment in each document, by the mean and deviation of the series."""
    mean, sd = scaling(sentiment_series(m, period, rolling, scale=False), *(scaling_period or ()))
    return topic_sentiment(m, method).select("doc_id", "topic", ((F.col("s") - mean) / sd).alias("s"))


def _parts(m: TopicModel, method: str = "proportional") -> DataFrame:
    """(doc_id, topic, theta, s): s is the topic's own for an rJST with sentiment of its own, else the document's."""
    if m.kind == "jst":
        raise ValueError("topics of a JST have no sentiment of their own")
    if m.kind == "rjst" and m.internal_sentiment:
        return topic_sentiment(m, method)
    if m.kind == "rjst":
        warnings.warn("the sentiment is from outside: every topic of a document has the document's", stacklevel=3)
    theta = P.doc_l1(m).select("doc_id", F.col("l1").alias("topic"), F.col("p").alias("theta"))
    return theta.join(document_sentiment(m).withColumnRenamed("sentiment", "s"), "doc_id")


def sentiment_breakdown(m: TopicModel, period: str = "year", rolling: int = 1, scale: bool = False, scaling_period: tuple[str, str] | None = None) -> DataFrame:
    """(date, topic, value): what each topic adds to the sentiment of a period; 'sentiment' is their sum. Identity: per
    document (doc_id, date, topic, value), unscaled."""
    parts = _parts(m)
    if period == "identity":
        out = _dated(m, parts).select("doc_id", "date", _label(m.topic_labels, "topic").alias("topic"), (F.col("s") * F.col("theta")).alias("value"))
        return out
    if scale:
        mean, sd = scaling(sentiment_series(m, period, rolling, scale=False), *(scaling_period or ()))
        parts = parts.withColumn("s", (F.col("s") - mean) / sd)
    x = _dated(m, parts).withColumn("date", floor_date(F.col("date"), period)).withColumn("value", F.col("s") * F.col("theta"))
    means = x.groupBy("date", _label(m.topic_labels, "topic").alias("topic")).agg(F.avg("value").alias("value"))
    whole = means.groupBy("date").agg(F.sum("value").alias("value")).withColumn("topic", F.lit("sentiment"))
    return roll(means.unionByName(whole), period, rolling, ["topic"])


def sentiment_topics(m: TopicModel, period: str = "year", rolling: int = 1, scale: bool = False, scaling_period: tuple[str, str] | None = None) -> DataFrame:
    """(date, topic, value): mean sentiment of each topic, weighted by its shares. Identity: s times the share."""
    parts = _parts(m)
    if period == "identity":
        return sentiment_breakdown(m, "identity")
    if scale:
        mean, sd = scaling(sentiment_series(m, period, rolling, scale=False), *(scaling_period or ()))
        parts = parts.withColumn("s", (F.col("s") - mean) / sd)
    x = _dated(m, parts).withColumn("date", floor_date(F.col("date"), period))
    means = x.groupBy("date", _label(m.topic_labels, "topic").alias("topic")).agg((F.sum(F.col("s") * F.col("theta")) / F.sum("theta")).alias("value"))
    return roll(means, period, rolling, ["topic"])


def proportion_topics(m: TopicModel, period: str = "year", rolling: int = 1, complete: bool = True) -> DataFrame:
    """(date, topic, value): mean proportions by period; complete: of the leaves, else of the first layer. Identity: per
    document."""
    if complete and m.L2 > 1:
        x = P.doc_mixtures(m).withColumn("z", F.col("l1") * m.L2 + F.col("l2")).select("doc_id", _label(m.leaf_labels(), "z").alias("topic"), F.col("p").alias("value"))
    else:
        x = P.doc_l1(m).select("doc_id", _label(m.l1_labels, "l1").alias("topic"), F.col("p").alias("value"))
    x = _dated(m, x)
    if period == "identity":
        return x.select("doc_id", "date", "topic", "value")
    means = x.groupBy(floor_date(F.col("date"), period).alias("date"), "topic").agg(F.avg("value").alias("value"))
    return roll(means, period, rolling, ["topic"])


def wide(series: DataFrame, columns: list[str]) -> DataFrame:
    """date and a column per topic, in the order given."""
    return series.groupBy("date").pivot("topic", columns).agg(F.first("value")).orderBy("date")


def plot_table(series: DataFrame, period: str, ridgeline: bool = False) -> DataFrame:
    """A series for plotting, on its whole calendar: gaps carry the last value forward; width and centre of each bar in
    days; ridgeline: height as a share of the largest absolute value."""
    ends = series.agg(F.min("date").alias("a"), F.max("date").alias("z"), F.collect_set("topic").alias("t"))
    calendar = ends.select(F.explode(F.expr(f"sequence(a, z, {PERIODS[period]})")).alias("date"), "t").select("date", F.explode("t").alias("topic"))
    order = Window.partitionBy("topic").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = calendar.join(series, ["date", "topic"], "left").withColumn("value", F.last("value", ignorenulls=True).over(order))
    width = F.datediff(F.expr(f"cast(date + {PERIODS[period]} as date)"), F.col("date"))
    out = out.withColumn("width", width).withColumn("centre", F.expr("date_add(date, cast(width / 2 as int))"))
    return out.withColumn("height", F.col("value") / F.max(F.abs("value")).over(Window.partitionBy())) if ridgeline else out


def apply_rolling(series: DataFrame, window: int, fun: Callable) -> DataFrame:
    """Any Python function of a list of values, right-aligned; for the few rows of a series."""

    def go(pdf):
        pdf = pdf.sort_values("date")
        return pdf.assign(value=pdf["value"].rolling(window).apply(fun))

    return series.groupBy("topic").applyInPandas(go, series.schema)
