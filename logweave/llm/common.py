"""Helpers shared by the operators of this package."""

from __future__ import annotations

import string
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.session import scratch_path

# Tasks get the functions of this package with their closures, so an executor
# needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes A-Z as a-z; all other bytes, those of UTF-8 sequences among them, stay.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def lower_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER)


def sampled(df: DataFrame, key: Column, rows: int, bound: int) -> DataFrame:
    """About ``bound`` of ``rows`` rows, picked by a hash of ``key``: the same rows on every run."""
    if rows <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / rows))


def to_numpy(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table whose size has a stated bound."""
    got = df.toArrow()
    return {name: got.column(name).to_numpy(zero_copy_only=False) for name in got.column_names}


def texts(series: pd.Series) -> list[str]:
    return ["" if x is None else x for x in series]


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder with strong compression and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
