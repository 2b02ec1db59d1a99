"""Dense positions without a global window.

Rows are cut into ranges of a key by explicit limits, which are the same in every scan
(limits that Spark samples for a range exchange may differ from one plan to the next).
Each range's total reaches the driver, one number for each range, and comes back as a
literal; every range then numbers its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

ROWS = 50_000
"""Rows of a range, about; small inputs have one range."""
SAMPLED = 64
"""Keys that are sampled for each range."""


def ranged(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """df with __part, the number of the key's range; null keys come first."""
    spark = df.sparkSession
    total = df.count()
    ranges = min(-(-total // rows), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if ranges <= 1:
        return df.withColumn("__part", F.lit(0))
    share = min(1.0, SAMPLED * ranges / total)
    spin = F.pmod(F.xxhash64(F.to_json(F.struct(key))), F.lit(1 << 20))
    keys = df.select(key).where(F.col(key).isNotNull() & (spin <= int(share * (1 << 20)))).orderBy(key).collect()
    cuts = [keys[len(keys) * k // ranges][0] for k in range(1, ranges)] if keys else []
    schema = StructType([StructField("__cuts", ArrayType(df.schema[key].dataType))])
    limits = spark.createDataFrame([(cuts,)], schema)
    above = F.size(F.filter("__cuts", lambda c: c <= F.col(key)))
    return df.crossJoin(F.broadcast(limits)).withColumn("__part", F.when(F.col(key).isNull(), 0).otherwise(above)).drop("__cuts")


def _before(parted: DataFrame, amount: Column) -> Column:
    """What all earlier ranges hold together, as a function of __part."""
    totals = dict(parted.groupBy("__part").agg(amount).collect())
    out, sums = 0, []
    for p in range(max(totals, default=0) + 1):
        sums.append(out)
        out += totals.get(p) or 0
    return F.element_at(F.array(*(F.lit(s).cast("long") for s in sums)), F.col("__part") + 1)


def ordinals(df: DataFrame, key: str, name: str, rows: int = ROWS) -> DataFrame:
    """df with dense 0-based positions in order of key."""
    parted = ranged(df, key, rows)
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return parted.withColumn(name, (_before(parted, F.count("*")) + own - 1).cast("long")).drop("__part")


def running(df: DataFrame, key: str, size: str, name: str, rows: int = ROWS) -> DataFrame:
    """df with the sum of size over all rows with a smaller key."""
    parted = ranged(df, key, rows)
    w = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parted.withColumn(name, (_before(parted, F.sum(size)) + F.coalesce(F.sum(size).over(w), F.lit(0))).cast("long")).drop("__part")
