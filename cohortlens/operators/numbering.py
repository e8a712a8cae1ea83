"""Ranks in the order of a hash, without sorting a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_ranked(df: DataFrame, by: tuple[str, ...], identity: Column, name: str = "rank") -> DataFrame:
    """df (whose columns aren't called h__ or r__) with each row's place, from 0 on, among those with equal ``by`` in the
    order of the MD5 of ``identity``; rows of equal identity in any order.

    Rows are counted by ranges of the hash (4 hex digits), and only inside a range of a key they are sorted; so a key that
    holds most rows is spread over 65,536 of them. Both sides of the join derive the range from the row, whatever
    partitions it has been in. Null keys are keys."""
    rows = df.withColumn("h__", F.md5(identity.cast("string"))).withColumn("r__", F.substring("h__", 1, 4))
    sizes = rows.groupBy(*by, "r__").agg(F.count("*").alias("n__"))
    since = sizes.withColumn("since__", F.sum("n__").over(Window.partitionBy(*by).orderBy("r__")) - F.col("n__")).drop("n__")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "r__")]
    both = rows.alias("a").join(since.alias("b"), same).select("a.*", "since__")
    place = F.row_number().over(Window.partitionBy(*by, "r__").orderBy("h__")) - 1
    return both.withColumn(name, (F.col("since__") + place).cast("long")).drop("h__", "r__", "since__")
