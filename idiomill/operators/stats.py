"""Descriptions of idiom tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _five(c: Column, name: str, median: bool = True) -> list[Column]:
    c = c.cast("double")
    out = [F.round(F.avg(c), 6).alias(f"{name}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    return [*out, F.median(c).alias(f"{name}_median")] if median else out


def describe(idioms: DataFrame) -> DataFrame:
    """One row over rows (idiom, entities, literal_meanings, figurative_meanings): numbers, lengths and list sizes.

    Null lists count as empty.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    lists = [("entities", "entities"), ("literal", "literal_meanings"), ("figurative", "figurative_meanings")]
    aggs = [F.count("*").alias("total"), F.countDistinct("idiom").alias("distinct_idioms")]
    aggs += _five(X.word_count("idiom"), "words") + _five(F.length("idiom"), "chars")
    for name, c in lists:
        aggs += [*_five(size(c), name, False), F.count_if(size(c) > 0).alias(f"{name}_with")]
    aggs.append(F.coalesce(F.sum(size("entities")), F.lit(0)).cast("long").alias("entities_total"))
    unique = idioms.select(F.explode("entities").alias("e")).agg(F.countDistinct("e").alias("entities_unique"))
    return idioms.agg(*aggs).crossJoin(unique)


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """(bin, n), of each group if ``by``: bins of equal width from minimum to maximum, the last one closed."""
    limits = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(limits)).withColumn("bin", at.cast("long"))
    return rows.groupBy(*([by] if by else []), "bin").agg(F.count("*").alias("n"))
