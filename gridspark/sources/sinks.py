"""Writing datasets: Parquet with a schema beside it, NetCDF classic files per slice, or nothing at all."""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import GridSchema, apply_ncml
from . import netcdf3


def write_parquet(df: DataFrame, path: str, schema: GridSchema | None = None, partition_by: str | None = None, compression: str = "zstd", mode: str = "error") -> None:
    """Cells by the unlimited dimension, and the schema as text in ``_schema``, both by Spark's writers."""
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(partition_by) if partition_by else w).parquet(f"{path}/cells")
    if schema is not None:
        df.sparkSession.createDataFrame([(schema.without_unused_dims().to_ncml(),)], "ncml string").coalesce(1).write.mode(mode).parquet(f"{path}/_schema")


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, GridSchema | None]:
    try:
        text = spark.read.parquet(f"{path}/_schema").first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = None
    return spark.read.parquet(f"{path}/cells"), apply_ncml(text) if text else None


def write_nothing(df: DataFrame) -> None:
    """Runs everything and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_netcdf(df: DataFrame, folder: str, value: str, dims: Iterable[str], lengths: dict[str, int], t: str, kind: str = "float", scale: float = 1.0, offset: float = 0.0, fill: float = -32767.0, attrs: dict | None = None) -> DataFrame:
    """A file ``<t>.nc`` in ``folder`` per position of the unlimited dimension, written by the tasks; returns (t, file) of what was written.

    ``folder`` must be one that all executors share. A file is written under another name first, so a repeated task leaves it whole.
    """
    dims = [d for d in dims if d != t]
    shape = tuple(lengths[d] for d in dims)
    dtype = {"float": np.float32, "double": np.float64, "short": np.int16, "int": np.int32}[kind]
    about = {"_FillValue": dtype(fill), **({"scale_factor": scale} if scale != 1 else {}), **({"add_offset": offset} if offset else {}), **(attrs or {})}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf[t].iloc[0])
        v = np.full(shape, np.nan)
        v[tuple(pdf[d].to_numpy() for d in dims)] = pdf[value].to_numpy(float, na_value=np.nan)
        packed = (v - offset) / scale
        packed = np.round(packed) if dtype in (np.int16, np.int32) else packed
        packed = np.where(np.isnan(v), fill, packed).astype(dtype)
        path = os.path.join(folder, f"{at:08d}.nc")
        netcdf3.write(f"{path}.part-{os.getpid()}", {t: 1, **{d: lengths[d] for d in dims}}, [(t, [t], {}, np.array([float(at)])), (value, [t, *dims], about, packed[None])], None, t)
        os.replace(f"{path}.part-{os.getpid()}", path)
        return pd.DataFrame({t: [at], "file": [path]})

    return df.select(t, *dims, value).groupBy(t).applyInPandas(run, f"{t} int, file string")


def convert_unit_on_write(df: DataFrame, value: str, source: str, target: str) -> DataFrame:
    from ..functions.units import convert

    return df.withColumn(value, convert(F.col(value), source, target))
