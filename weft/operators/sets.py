"""Unions, differences and choices of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of all tables, by column name; a column that a table lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing_from(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of rows that known lacks; a null key counts as a key of its own."""
    return rows.select(*keys).distinct().subtract(known.select(*keys))


def known_values(column: str, *frames: DataFrame) -> DataFrame:
    """Distinct non-null values of a column over several tables."""
    return reduce(DataFrame.unionByName, (f.select(column) for f in frames)).where(F.col(column).isNotNull()).distinct()


def subsample(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows at random without replacement: the smallest hashes of the id, so that the choice repeats. Spark keeps n rows a task, not a full sort."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(n)


def largest(rows: DataFrame, n: int, area: str, id_col: str) -> DataFrame:
    """The n rows of largest area, ties to the smaller id."""
    return rows.where(F.col(area).isNotNull()).orderBy(F.desc(area), id_col).limit(n)


def bucket_load(rows: DataFrame, bucket: str) -> DataFrame:
    """rows with load, the number of rows in the same bucket; rows without one share one bucket. Counted before the join, so a hot bucket is one number."""
    name = F.coalesce(F.col(bucket).cast("string"), F.lit("<none>"))
    keyed = rows.withColumn("_bucket", name)
    return keyed.join(keyed.groupBy("_bucket").agg(F.count("*").alias("load")), "_bucket").drop("_bucket")


def format_id(prefix: str, number: Column, width: int) -> Column:
    """An id such as 'node-00042'."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def top_labels(rows: DataFrame, key: str, label: str, weight: str, k: int) -> DataFrame:
    """key, labels: each key's k heaviest labels in order, ties by name; null labels don't count."""
    sums = rows.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.sum(weight).alias("w"))
    ranked = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), F.col(label).alias("label")))).alias("l"))
    return ranked.select(key, F.transform(F.slice("l", 1, k), lambda x: x["label"]).alias("labels"))
