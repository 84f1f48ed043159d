"""Normalised scores as Column expressions. n: nodes reached, td: total depth, l and tdl: their length-weighted forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standard(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - min) / (max - min) over the whole table; 1 where all are equal. One row with both is joined to all."""
    ends = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    x = F.when(F.col("__high") > F.col("__low"), (F.col(column) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))).otherwise(1.0)
    return df.join(F.broadcast(ends)).withColumn(out, x).drop("__low", "__high")


def choice(x: Column, n: Column) -> Column:
    return F.when(n > 2, x / F.nullif((n - 1) * (n - 2), F.lit(0))).otherwise(x)


def betweenness(x: Column, n: Column) -> Column:
    return F.when(n > 2, 2 * x / F.nullif((n - 1) * (n - 2), F.lit(0))).otherwise(x)


def choice_syntax(x: Column, td: Column) -> Column:
    return F.log10(x + 1) / F.log10(td + 2)


def integration(n: Column, td: Column) -> Column:
    return (n - 1) / (td + 1)


def integration_length(length: Column, tdl: Column) -> Column:
    return length / (tdl + 1)


def integration_syntax(n: Column, td: Column) -> Column:
    return F.pow(n.cast("double"), F.lit(1.2)) / (td + 1)


def integration_hillier(n: Column, td: Column) -> Column:
    return n * n / (td + 1)


def mean_depth(n: Column, td: Column) -> Column:
    return F.when(n > 1, td / F.nullif(n - 1, F.lit(0))).otherwise(0.0)


def network_integration(n: Column, td: Column) -> Column:
    """Inverse real relative asymmetry with the diamond value; -1 below 2 nodes, null for 2."""
    k = n.cast("double")
    mean = td / F.nullif(k - 1, F.lit(0.0))
    asymmetry = 2 * (mean - 1) / F.nullif(k - 2, F.lit(0.0))
    diamond = 2 * ((F.log2((k + 2) / 3) - 1) * k + 1) / F.nullif((k - 1) * (k - 2), F.lit(0.0))
    return F.when(n < 2, -1.0).otherwise(diamond / F.nullif(asymmetry, F.lit(0.0)))
