"""Sizes of thread pools, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pool_size(cores: Column, cpu_weight: Column, io_weight: Column) -> Column:
    both_zero = (cpu_weight == 0) & (io_weight == 0)
    size = F.ceil(cores * cpu_weight) + F.ceil(cores * io_weight * 4)
    return F.when(both_zero, F.raise_error(F.lit("both weights are zero")).cast("bigint")).otherwise(size).cast("bigint")


def ideal_threads(cores: Column, io_bound: Column, wait_ratio: Column) -> Column:
    return F.when(io_bound, F.ceil(cores * (1 + wait_ratio))).otherwise(cores + 1).cast("bigint")
