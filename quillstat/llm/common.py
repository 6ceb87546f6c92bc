"""Helpers shared by the corpus operators: words, tables cut from lineage, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstat.sources.tables import release, shared_dir, tables_made, written  # noqa: F401  (part of these helpers)

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"

U64 = np.uint64


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def words(column: Column) -> Column:
    """All runs of anything but the six ASCII white-space characters."""
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def binary_lists(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, empty for null."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def with_fields(ddl: str, df: DataFrame, names: list[str]) -> T.StructType:
    """The schema of the DDL string with those columns of ``df`` behind it."""
    return T.StructType([*T.StructType.fromDDL(ddl).fields, *[T.StructField(n, df.schema[n].dataType) for n in names]])


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column ``name`` has about so many bytes in each; a longer value stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name)).cast(pa.binary())), 0)
        part = np.cumsum(size.to_numpy(zero_copy_only=False)) // most
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            yield batch.slice(i, j - i)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def sharded(df: DataFrame, key: str, rows_per_part: int, rows: int) -> DataFrame:
    """Deals rows by key into parts of about so many rows."""
    return df.repartition(max(1, -(-rows // rows_per_part)), key)
