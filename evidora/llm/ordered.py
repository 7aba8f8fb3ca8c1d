"""Walking a table in the order of its ids, with sight of the next row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, range_bounds, range_bucket


def in_order_with_next(df: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = ("text",)) -> DataFrame:
    """Deal ``df`` into sorted key ranges, each followed by the first rows of the next range.

    Adds ``_next_range`` (0 own row, 1 row of the next range; after the last
    range comes the first).  Every range lies in one partition, sorted by
    (``_next_range``, key, ties), so a task sees each own row's follower.
    Rows with equal keys share a range; the driver holds one row a range.
    """
    spark = df.sparkSession
    n = partitions(spark)
    bounds = range_bounds(df, key, n)
    place = F.coalesce(F.col(key), F.lit(-(1 << 63)))  # null ids come first
    bucket = range_bucket(F.col(key), bounds)
    heads = sorted(df.groupBy(bucket.alias("b")).agg(F.min(place).alias("head")).collect())
    follow = [(b, head, heads[i - 1][0]) for i, (b, head) in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(follow, "_bucket int, _head long, _previous int"))
    own = F.struct(F.col("_bucket").alias("to"), F.lit(0).alias("next_range"))
    lent = F.struct(F.col("_previous").alias("to"), F.lit(1).alias("next_range"))
    dealt = (
        df.withColumn("_bucket", bucket)
        .join(table, "_bucket")
        .withColumn("_deal", F.explode(F.when(place == F.col("_head"), F.array(own, lent)).otherwise(F.array(own))))
        .select(*df.columns, F.col("_deal.next_range").alias("_next_range"), F.col("_deal.to").alias("_to"))
    )
    return dealt.repartitionById(max(1, len(bounds) + 1), "_to").sortWithinPartitions("_next_range", key, *ties).drop("_to")
