"""Folds by the CRC-32 of the id as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def held_out(id_column: Column, folds: int, which: int) -> Column:
    """Whether the id lies in the fold that nothing is learned from; false for a null id."""
    return F.coalesce(remainder(id_column, folds) == which, F.lit(False))


def learned(id_column: Column, folds: int, which: int) -> Column:
    """Whether the id lies in another fold; false for a null id."""
    return F.coalesce(remainder(id_column, folds) != which, F.lit(False))
