"""The workload's results as delimited text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from tessella.plans import workload
from tessella.sources.delimited import write_csv


def write_results(spark: SparkSession, sf_dir: str, out_dir: str, names: Iterable[str] | None = None, mode: str = "errorifexists") -> list[str]:
    """Run queries (all if none are named) and write each one's rows into out_dir/result<i>.csv, i being its number.

    Spark writes a folder of parts whose order is that of the rows. Returns the folders.
    """
    order, out = list(workload.QUERIES), []
    for name in order if names is None else names:
        if name not in workload.QUERIES:
            raise ValueError(f"no query {name}")
        out.append(f"{out_dir.rstrip('/')}/result{order.index(name)}.csv")
        write_csv(workload.QUERIES[name](spark, sf_dir), out[-1], mode=mode)
    return out
