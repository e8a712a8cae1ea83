"""Running totals over streams. The batch operators' class counts are sums, so they run unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators import metrics


def running_class_counts(stream: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Class counts of all predictions (target, probs, by) so far; state is a row for each key."""
    return metrics.class_counts(metrics.with_prediction(stream), classes, by)


def windowed_accuracy(stream: DataFrame, time: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and accuracy of each time window; windows close once the watermark has passed them."""
    rows = metrics.with_prediction(stream).withWatermark(time, late)
    hit = (F.col("target") == F.col("prediction")).cast("double")
    return rows.groupBy(F.window(time, every).alias("w")).agg(F.count("*").alias("rows"), F.avg(hit).alias("accuracy")).select("w.start", "w.end", "rows", "accuracy")


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Runs a streaming query over what is there now, into a table of that name."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)
