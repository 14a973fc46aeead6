"""Statistics of fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small

BYTES = {"byte": 1, "short": 2, "int": 4, "float": 4, "double": 8, "long": 8, "char": 1}


#: Ranges of values for each factor of e; a field has as many counts at most as there are ranges among its values.
RANGES = 2048


def value_range(v: Column) -> Column:
    """The number of a value's range, which never falls where values rise: finer towards 0, NaN last."""
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(750.0)) * RANGES) + 750 * RANGES  # positive for every double, and infinity has one
    return F.when(F.isnan(v), F.lit(1 << 62)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def upper_median(df: DataFrame, value: str, by: Iterable[str]) -> DataFrame:
    """``(by, median)`` of each field with defined values, of an even number the upper one of the middle two.

    Values are counted by range, which finds the range that the median is in; only distinct values of that range are put in order.
    So no task gets a whole field, unless most of its cells have different values within a range.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).withColumn("_range", value_range(F.col("_v").cast("double")))
    order = lambda c: Window.partitionBy(*by).orderBy(c)
    upto = lambda n, c: F.sum(n).over(order(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumns({"_upto": upto("_n", "_range"), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    rank = F.floor(F.col("_all") / 2) + 1
    picked = counts.where((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))).select(*(F.col(b).alias(f"_{b}") for b in by), F.col("_range").alias("_picked"), (rank - F.col("_upto") + F.col("_n")).alias("_rank"))
    same = F.col("_range") == F.col("_picked")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    inside = rows.join(small(picked), same).groupBy(*by, "_v", "_rank").agg(F.count("*").alias("_n")).withColumn("_upto", upto("_n", "_v"))
    return inside.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))).select(*by, F.col("_v").alias("median"))


def field_stats(df: DataFrame, value: str, by: Iterable[str]) -> DataFrame:
    """Per field: how many values are defined and missing, sum, mean, upper median, least, largest, and sample standard deviation.

    Without fields ``by`` there is one row for all cells.
    """
    by, v = list(by), F.col(value)
    plain = df.groupBy(*by).agg(F.count(v).alias("n_def"), F.count_if(v.isNull()).alias("n_undef"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("largest"), F.stddev_samp(v).alias("stddev"))
    middle = upper_median(df, value, by).select(*(F.col(b).alias(f"_{b}") for b in by), "median")
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return plain.join(middle, same, "left").select(*by, "n_def", "n_undef", "total", "mean", "median", "least", "largest", "stddev")


def over_fields(fields: DataFrame) -> DataFrame:
    """Least, largest and mean over all defined cells of all fields, from their ``field_stats``."""
    return fields.agg(F.min("least").alias("least"), F.max("largest").alias("largest"), F.try_divide(F.sum("total"), F.sum("n_def")).alias("mean"), F.sum("n_def").alias("n_def"))


def dataset_bytes(dims: dict[str, int], variables: dict[str, tuple[str, list[str]]]) -> int:
    """Bytes of all variables, given dimensions' lengths and each variable's kind and dimensions."""
    total = 0
    for kind, shape in variables.values():
        n = BYTES[kind]
        for d in shape:
            n *= dims[d]
        total += n
    return total


def only_value(df: DataFrame, column: str):
    """The one distinct value of a column; ValueError if there are none or more."""
    got = df.select(column).distinct().limit(2).collect()
    if len(got) != 1:
        raise ValueError(f"{column} has not one value")
    return got[0][0]
