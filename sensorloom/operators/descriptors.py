"""Nearest descriptors of a stated query set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.session import estimated_bytes

BLOCK_BYTES = 32 << 20


def two_nearest(queries: DataFrame, rows: DataFrame, row_id: str, vector: str, other: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(q_id, row_id, first, second): nearest row of each query and the distances of the two nearest, over rows whose `other` columns differ.

    The query set is held against all rows in blocks that stay under block_bytes by
    Catalyst's estimate; each block is broadcast, and a block's candidates are cut to two a
    query before the shuffle. Of equally near rows the smaller id. Null ids and vectors take no part.
    """
    q = queries.select(F.col(row_id).alias("q_id"), F.col(vector).alias("q"), *[F.col(c).alias(f"q_{c}") for c in other]).where("q_id is not null and q is not null")
    r = rows.select(row_id, vector, *other).where(F.col(row_id).isNotNull() & F.col(vector).isNotNull())
    blocks = 1 + 4 * estimated_bytes(q) // block_bytes  # columnar files unpack to a few times their size
    differ = reduce(lambda a, c: a & (F.col(c) != F.col(f"q_{c}")), other, F.lit(True)) if other else F.col(row_id) != F.col("q_id")
    d2 = F.aggregate(F.zip_with("q", vector, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("q_id").orderBy("dist", row_id)
    parts = []
    for n in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == n)
        pairs = r.join(F.broadcast(part), differ).select("q_id", row_id, F.sqrt(d2).alias("dist"))
        top = pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
        best = F.min(F.when(F.col("rank") == 1, F.struct("dist", row_id)))
        parts.append(top.groupBy("q_id").agg(best.alias("b"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("second")))
    return reduce(DataFrame.unionByName, parts).select("q_id", F.col(f"b.{row_id}").alias(row_id), F.col("b.dist").alias("first"), "second")
