"""Deduplication across instalments: a ledger of keys seen, and a filter in front of it.

A study that grows need not read its earlier documents again. Every instalment stores the keys
that it added, 16 bytes each, and a Bloom filter of them in blocks of 512 bits: a key has one block
and one bit in each of its eight words, so the filter is a table of a row per block, made by
``bit_or`` in the map tasks and joined by block. It has about a tenth of the size of the keys. Only keys that the
filter knows, which are the copies and a few others, are looked up in the ledger.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.stages import shared_dir, write_stage

WORDS = 8
#: Blocks of a filter: some 40 keys a block let about one key in 200 through that is not there.
BLOCKS, KEYS_PER_BLOCK = 1 << 20, 40


def ledger_key(*parts: Column) -> Column:
    """16 bytes that stand for the values; a null is a value of its own."""
    marked = [F.when(p.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(p.cast("string")), F.lit(":"), p.cast("string"))) for p in parts]
    return F.unhex(F.md5(F.concat(*marked)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit of each word, by six bits of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def block_filter(keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(block, w0 to w7) of the keys in column ``key``."""
    masked = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return masked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def may_hold(keys: DataFrame, bits: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``keys`` whose key the filter knows; it misses none that is there."""
    probe = keys.withColumn("_block", _block(F.col("key"), blocks))
    joined = probe.join(bits.withColumnRenamed("block", "_other"), F.col("_block") == F.col("_other"))
    known = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("key")))])
    return joined.filter(known).select(*keys.columns)


class Ledger:
    """Keys of a study under ``path``, by instalment. ``blocks`` must stay the same for all of them."""

    def __init__(self, spark: SparkSession, path: str, blocks: int = BLOCKS):
        self.spark, self.path, self.blocks = spark, path.rstrip("/"), blocks

    def _read(self, kind: str, names: Sequence[str]) -> DataFrame | None:
        if not names:
            return None
        try:
            return self.spark.read.parquet(*[f"{self.path}/{n}/{kind}" for n in names])
        except AnalysisException as e:
            raise ValueError(f"no {kind} of some instalment under {self.path}: {e}") from e

    def bits(self, names: Sequence[str]) -> DataFrame | None:
        """The filters of the instalments as one."""
        found = self._read(f"filter-{self.blocks}", names)
        return found and found.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])

    def new(self, keys: DataFrame, before: Sequence[str]) -> DataFrame:
        """The rows of ``keys`` whose key none of the earlier instalments has."""
        bits = self.bits(before)
        if bits is None:
            return keys
        path = shared_dir(self.spark, "possible")
        write_stage(may_hold(keys.select("key").distinct(), bits, self.blocks), path)
        possible = self.spark.read.parquet(path)
        # Few keys are sent to the ledger where they lie; many are joined by shuffle. Spark knows the stored size.
        seen = self._read("keys", before).join(possible, "key").select(F.col("key").alias("_seen")).distinct()
        return keys.join(seen, F.col("key") == F.col("_seen"), "left_anti")

    def add(self, keys: DataFrame, name: str) -> int:
        """Stores the keys of an instalment, in place of what it stored before; returns their number."""
        n = write_stage(keys.select("key"), f"{self.path}/{name}/keys")
        stored = self.spark.read.schema("key binary").parquet(f"{self.path}/{name}/keys")
        write_stage(block_filter(stored, self.blocks), f"{self.path}/{name}/filter-{self.blocks}")
        return n

    def passed(self, names: Sequence[str], probes: int = 100_000) -> float:
        """Measured share of keys that are not there and that the filter lets through."""
        asked = self.spark.range(probes).select(ledger_key(F.lit("probe"), F.col("id")).alias("key"))
        bits = self.bits(names)
        return 0.0 if bits is None else may_hold(asked, bits, self.blocks).count() / probes
