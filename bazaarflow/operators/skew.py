"""A left join that slices hot keys itself.

It needs no help from AQE, which streaming micro-batches run without, and which does not split the
facts where the other side is itself the result of a join on the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_PER_PARTITION = 4
_NULL_SLICES = 1 << 20


def sliced_left_join(
    facts: DataFrame, side: DataFrame, fact_key: str, side_key: str, row_id: str,
) -> DataFrame:
    """``facts`` left-joined to ``side``, which is unique on ``side_key``.

    A key is hot when it holds more than 1 / (HOT_PER_PARTITION * shuffle partitions) of the
    facts. Its facts are cut by ``row_id`` into slices of that size, and its one side row is
    repeated per slice. So many keys at most can be hot, which bounds the broadcast list, and no
    key above that share stays whole. Facts without a key match nothing and are simply spread.
    The facts are read a second time, one column of them, to count the keys: they should be a
    table rather than a long computation.
    """
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = HOT_PER_PARTITION * partitions
    sizes = facts.where(F.col(fact_key).isNotNull()).groupBy(
        F.col(fact_key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))  # one row
    hot = F.broadcast(
        sizes.join(F.broadcast(total)).where(F.col("_n") * parts > F.col("_total"))
        .select("_hot_key", F.ceil(F.col("_n") * parts / F.col("_total")).cast("int").alias("_slices")))
    number = (
        F.when(F.col(fact_key).isNull(), F.lit(_NULL_SLICES))
        .otherwise(F.coalesce("_slices", F.lit(1))))
    cut = facts.join(hot, F.col(fact_key) == F.col("_hot_key"), "left").withColumn(
        "_slice", F.pmod(F.xxhash64(row_id), number).cast("int")).drop("_hot_key", "_slices")
    repeated = side.join(hot, F.col(side_key) == F.col("_hot_key"), "left").withColumn(
        "_side_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    ).drop("_hot_key", "_slices")
    match = (F.col(fact_key) == F.col(side_key)) & (F.col("_slice") == F.col("_side_slice"))
    return cut.join(repeated, match, "left").drop("_slice", "_side_slice")
