"""Intermediate tables in the folder that the driver and all executors share, and small helpers on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.workspace import materialize, new_path, shared_dir

__all__ = ["discard", "fresh", "marked", "materialize", "new_path", "shared_dir", "table", "text_keys", "text_or_empty", "without"]


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any longer."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/arborlens/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not use, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_keys(text_col: str = "text", *more: str) -> Column:
    """128 bits that name a text (and the columns `more`), as a struct of two longs; a null text has keys of its own."""
    own = [F.col(text_col), *[F.col(c) for c in more]]
    return F.struct(F.xxhash64(*own).alias("k1"), F.xxhash64(F.lit(1), *own).alias("k2"))


def marked(rows: DataFrame, name: str, key: Column, keys: DataFrame, bits: int = 24) -> DataFrame:
    """rows with a boolean column `name`: false where the 64-bit hash `key` is surely not among `keys` (one column of such
    hashes), true where it may be.

    The keys become a bitmap of 2^bits bits (2 MB for 24), which is all that is broadcast, whatever their number; the
    more of them, the more rows are marked for nothing, and no row is ever missed. So a join with a decision that
    concerns few rows shuffles the text of few rows.
    """
    number = keys.columns[0]
    # bitmap buckets count from 1; the top bits of a hash are as good as any
    slot = lambda c: F.shiftrightunsigned(c, 64 - bits) + 1
    maps = keys.select(slot(F.col(number)).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bytes"))
    bucket, held, at = fresh(rows, "_bucket"), fresh(rows, "_words"), fresh(rows, "_slot")
    # the 4,096 bytes of a bucket as 512 longs, first byte highest, so that a test is one look into an array
    words = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("bytes", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    maps = materialize(maps.select(F.col("bucket").alias(bucket), words.alias(held)), "bitmap")
    rows = rows.withColumn(at, slot(key))
    out = rows.join(F.broadcast(maps), F.bitmap_bucket_number(F.col(at)) == F.col(bucket), "left")
    place = F.bitmap_bit_position(F.col(at))
    word = F.get(held, F.shiftright(place, 6).cast("int"))
    bit = (7 - F.shiftright(place, 3).bitwiseAND(F.lit(7))) * 8 + place.bitwiseAND(F.lit(7))
    hit = F.coalesce(F.getbit(word, bit.cast("int")) == 1, F.lit(False))
    return out.withColumn(name, hit).drop(bucket, held, at)


def without(docs: DataFrame, gone: DataFrame, text_col: str = "text", *more: str) -> DataFrame:
    """docs without the rows whose text_keys() are in gone (k1, k2). Only rows that the bitmap marks are shuffled."""
    flag, keys = fresh(docs, "_may_go"), fresh(docs, "_keys")
    gone = gone.select(F.col("k1").alias(f"{keys}1"), F.col("k2").alias(f"{keys}2"))
    rows = marked(docs.withColumn(keys, text_keys(text_col, *more)), flag, F.col(f"{keys}.k1"), gone.select(f"{keys}1"))
    same = (F.col(f"{keys}.k1") == F.col(f"{keys}1")) & (F.col(f"{keys}.k2") == F.col(f"{keys}2"))
    left = rows.where(flag).join(gone.hint("merge"), same, "left_anti")
    return rows.where(~F.col(flag)).unionByName(left).select(*docs.columns)
