"""Tables of sketches: the one-row source, Parquet stores, and what UPDATE and INSERT do to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.functions import blob
from tessera.functions.codec import DEFAULT_ACCURACY
from tessera.operators.merging import build, group_merge


def create(spark: SparkSession, accuracy: float | None = DEFAULT_ACCURACY) -> DataFrame:
    """One row: sketch, an empty sketch. None is the default accuracy; one outside (0, 1) raises ValueError."""
    empty = blob.empty(DEFAULT_ACCURACY if accuracy is None else accuracy)
    return spark.range(1).select(F.lit(bytearray(empty)).alias("sketch"))


def read(spark: SparkSession, path: str, column: str = "sketch") -> DataFrame:
    """A Parquet store; its sketch column must be binary."""
    df = spark.read.parquet(path)
    if not isinstance(df.schema[column].dataType, BinaryType):
        raise TypeError(f"{column} of {path} isn't binary")
    return df


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Writes a store. Partition columns let later reads skip files."""
    out = df.write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def with_values(store: DataFrame, values: DataFrame, value: Column | str, keys: list[str], accuracy: float = DEFAULT_ACCURACY) -> DataFrame:
    """The store after the values were added to the sketches of their keys, new keys included: an UPDATE in bulk."""
    new = build(values, value, keys, accuracy, column="s__").select(*keys, blob.from_struct("s__").alias("sketch"))
    return group_merge(store.select(*keys, "sketch").unionByName(new), keys).select(*keys, "sketch")


def coarser(store: DataFrame, time: str, unit: str, keys: list[str]) -> DataFrame:
    """The store by a coarser unit of time: INSERT INTO daily SELECT date_trunc(...), agg(sketch) FROM hourly."""
    rows = store.withColumn(time, F.date_trunc(unit, time))
    return group_merge(rows, [time, *keys]).select(time, *keys, "sketch")
