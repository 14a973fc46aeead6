"""Command line: runs a configuration over an input and writes or prints the result.

    python -m gridspark --input a.nc --variable v --dims t,y,x --config run.ini --output out
    python -m gridspark --input a.nc --print schema|size|stats
    python -m gridspark --input a.ncml --variable v,w --output out
    python -m gridspark --input a.grib --print messages
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .operators.stats import dataset_bytes
from .plans.config import run_config
from .plans.dataset import GridDataset, read
from .plans.ncml import open_ncml, schema_of
from .sources import grib, sinks


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="gridspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--input", required=True)
    p.add_argument("--type", help="netcdf3, ncml, grib, parquet, orc, csv, json; else by the file's name")
    p.add_argument("--variable")
    p.add_argument("--dims", default="t,y,x", help="dimension columns, outermost first")
    p.add_argument("--time", help="the unlimited dimension; the first by default")
    p.add_argument("--config", help="sections and keys as in run_config")
    p.add_argument("--output", help="a Parquet folder")
    p.add_argument("--print", choices=["schema", "size", "stats", "plan", "messages"])
    a = p.parse_args(args)
    start = lambda: spark or SparkSession.builder.appName("gridspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    described = None
    if a.type == "ncml" or a.input.endswith(".ncml"):
        with open(a.input) as f:
            described = open_ncml(start(), f.read(), os.path.dirname(a.input))
    if a.print in ("schema", "size"):
        s = described.schema if described else schema_of(a.input)
        return s.to_ncml() if a.print == "schema" else str(dataset_bytes(s.dims, {n: (v.kind, v.dims) for n, v in s.variables.items()}))
    spark = start()
    if described:
        data = described.dataset(*(v.strip() for v in a.variable.split(",")))
        df = data.df
    elif (a.type or "") == "grib" or a.input.endswith((".grib", ".grb", ".grib2", ".grb2")):
        messages = grib.messages(spark, a.input)
        if a.print == "messages":
            return "\n".join(map(str, messages.drop("message").orderBy("file", "offset").collect()))
        df = grib.cells(grib.name_by(messages, []))
    else:
        df = read(spark, a.input, a.type, a.variable)
    dims = data.dims if described else tuple(d.strip() for d in a.dims.split(","))
    data = GridDataset(df, dims, t=a.time or dims[0])
    if a.config:
        with open(a.config) as f:
            data = run_config(data, f.read())
    if a.output:
        sinks.write_parquet(data.df, a.output)
    if a.print == "plan":
        return data.df._jdf.queryExecution().toString()
    if a.print == "stats":
        return "\n".join(map(str, data.stats(a.variable or data.variables[0]).collect()))
    return f"{data.dims} {data.variables}"


if __name__ == "__main__":
    print(main())
