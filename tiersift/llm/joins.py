"""A join that no hot key can pile onto one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A key with more than one row in HOT_PART of a table is hot; there are fewer than HOT_PART such keys.
HOT_PART = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, n_left: int, how: str = "left") -> DataFrame:
    """left join right on key, where right has one row a key and a column n, that key's rows in left.

    Hot keys, fewer than HOT_PART by their definition, are broadcast. In the shuffle for the others the rows of
    hot keys go by their place instead, so no task gets more than its share and n_left / HOT_PART rows of a key.
    right should be a written table: it is read twice. Null keys match nothing.
    """
    bar, values = n_left / HOT_PART, [c for c in right.columns if c not in (key, "n")]
    hot = right.where(F.col("n") > bar).select(F.col(key).alias("_hot"), F.struct(*values).alias("_hot_values"))
    cold = right.where(F.col("n") <= bar).select(F.col(key).alias("_cold"), F.struct(*values).alias("_cold_values"))
    place = F.monotonically_increasing_id()
    if isinstance(right.schema[key].dataType, StringType):
        place = place.cast("string")
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # a place that happens to equal a cold key finds values that the next line passes over
    marked = marked.withColumn("_at", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), place).otherwise(F.col(key)))
    joined = marked.join(cold, F.col("_at") == F.col("_cold"), "left")
    own = F.col("_cold").isNotNull() & F.col("_hot").isNull() & F.col(key).isNotNull()
    found = F.when(F.col("_hot").isNotNull(), F.col("_hot_values")).when(own, F.col("_cold_values"))
    joined = joined.withColumn("_found", found)
    if how == "inner":
        joined = joined.where(F.col("_hot").isNotNull() | own)
    return joined.select(*left.columns, *[F.col("_found")[v].alias(v) for v in values])
