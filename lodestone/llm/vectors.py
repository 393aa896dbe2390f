"""What the operators on embeddings share: clean vectors, classes of equal ones, blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def cleaned(df: DataFrame, vec_id: str, vector: str, *more: str) -> DataFrame:
    """vec_id, embedding (doubles) and more of the rows that take part: those with an id and a usable
    vector. Of rows that repeat an id the smallest counts."""
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"), *more)
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return rows.groupBy("vec_id").agg(F.min(F.struct("embedding", *more)).alias("v")).select("vec_id", "v.*")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def blocked(df: DataFrame, blocks: str, member: str) -> DataFrame:
    """Each row once for each pair (lo, hi) of blocks that its own block is in."""
    own = F.pmod(F.xxhash64(member, F.lit("block")), F.col(blocks)).cast("int")
    df = df.withColumn("own", F.when(F.col(blocks) > 1, own).otherwise(F.lit(0)))
    df = df.withColumn("other", F.explode(F.when(F.col(blocks) > 1, F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)).otherwise(F.array(F.lit(0)))))
    return df.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")
