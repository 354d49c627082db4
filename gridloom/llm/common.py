"""Helpers shared by the training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialise  # noqa: F401

# Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Of likely(): keys to a block of 64 bits, and blocks at most (about 50 MB broadcast).
KEYS_A_BLOCK, BLOCKS = 8, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column if the table has it, else nulls of that type."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def boxed(docs: DataFrame, without: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """The columns named, and the row as the struct `row`: whatever names a table has,
    they cannot meet those that an operator works with. without: what the struct leaves out."""
    row = [F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(docs.columns) if c not in without]
    return docs.select(F.struct(*row or [F.lit(None).alias("none")]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unboxed(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `row` with the columns of docs."""
    return df.select(*[F.col(f"row.v{i}").alias(c) for i, c in enumerate(docs.columns)])


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(column(df, "text", "string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the text's words, in order."""
    parts = F.split(text, SPACE + "+", -1)
    return F.filter(parts, lambda w: w != "")


def salted(df: DataFrame, by: list[Column], salts: int) -> DataFrame:
    """The large side of a salted join."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))


def replicated(df: DataFrame, salts: int) -> DataFrame:
    """The small side of a salted join: each row once a salt."""
    return df.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))


def salted_join(large: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Equi-join whose keys may be hot on the large side only: its rows are dealt
    over `salts` tasks a key and the small side is repeated for each."""
    left = salted(large, [F.col(c) for c in by], salts)
    return left.join(replicated(small, salts), [*on, "_salt"], how).drop("_salt")


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose bigint `key` is in that column of wanted, and about 4 % of the
    others: what a join by the key that follows has to shuffle. wanted is read twice. A
    Bloom filter of 64-bit blocks with three bits a key is broadcast, one row for
    KEYS_A_BLOCK keys; over KEYS_A_BLOCK * BLOCKS keys it lets more of the others pass."""
    blocks = min(BLOCKS, wanted.count() // KEYS_A_BLOCK + 1)
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))
    drawn = F.xxhash64(F.col(key), F.lit(1))
    one, two, three = (F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(drawn, at).bitwiseAND(63).cast("int")) for at in (0, 6, 12))
    bits = one.bitwiseOR(two).bitwiseOR(three)
    has = wanted.groupBy(block.alias("_block")).agg(F.bit_or(bits).alias("_bits"))
    marked = df.withColumns({"_at": block, "_mask": bits})
    return marked.join(F.broadcast(has), (F.col("_at") == F.col("_block")) & (F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")), "left_semi").drop("_at", "_mask")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
