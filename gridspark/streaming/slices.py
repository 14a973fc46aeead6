"""Slices of a dataset that arrive as a stream: windowed statistics and running sums.

``windowed`` is an ordinary watermarked aggregate. ``running_sums`` keeps one number per cell as state; a trigger's rows of a cell are
added in order of time. Both take any streaming source of long-form rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState


def read_slices(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet slices that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(df: DataFrame, time: str, value: str, by: Iterable[str], length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, sum, least and largest value per window and group; rows later than ``late`` are left out."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    v = F.col(value)
    out = df.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("largest"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "least", "largest")


def running_sums(df: DataFrame, t: str, value: str, cell: Iterable[str]) -> DataFrame:
    """``cell, t, value``: sums up to each step; a missing value makes all later ones missing, but for the first step."""
    cell = list(cell)
    schema = T.StructType([*(df.schema[c] for c in [*cell, t]), T.StructField(value, T.DoubleType())])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, broken, begun = state.get if state.exists else (0.0, False, False)
        rows = pd.concat(list(parts)).sort_values(t)
        out = []
        for v in rows[value]:
            gone = pd.isna(v)
            broken = broken or (gone and begun)
            total += 0.0 if gone else float(v)
            out.append(None if broken or (gone and not begun) else total)
            begun = True
        state.update((total, broken, begun))
        done = rows[[*cell, t]].copy()
        done[value] = pd.Series(out, index=done.index, dtype="Float64")
        yield done

    return df.select(*cell, t, value).groupBy(*cell).applyInPandasWithState(step, schema, "total double, broken boolean, begun boolean", "append", "NoTimeout")


def append_slices(df: DataFrame, path: str, checkpoint: str, partition_by: str):
    """Starts a query that adds arriving slices to a Parquet dataset, each once; returns the query."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(partition_by).trigger(availableNow=True).start()
