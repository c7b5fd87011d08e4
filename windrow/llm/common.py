"""Shared helpers: tables, folds and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.storage import checkpointed, shared_folder, stored

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "checkpointed", "fold", "named", "packed", "shared_folder", "stored", "table", "unpacked"]

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.translate(col, UPPER, LOWER)


#: The name of the caller's columns while an operator works.
OWN = "callers_columns"


def packed(df: DataFrame, names: list[str] | None = None) -> Column:
    """The caller's columns (all, or the named ones) as one struct, so that no name of theirs meets one of an operator's own."""
    names = df.columns if names is None else names
    return F.struct(*[named(c).alias(c) for c in names] or [F.lit(0).alias("none")]).alias(OWN)


def unpacked(names: list[str]) -> list[Column]:
    """The named columns of the packed struct."""
    return [F.col(OWN).getField(c).alias(c) for c in names]


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)
