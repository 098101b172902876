"""Whole groups as NumPy columns, many to a batch.

groupBy().applyInPandas costs milliseconds for every group. Where groups are small
and many, sorted partitions are streamed through Arrow instead and cut at changes of
the key; a group that goes over a batch's end waits for its rest. Callers must bound
their groups (see chunked), as one group is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.tables import keep


def groups_of(batches, key: str) -> Iterator:
    """Arrow tables, each with whole groups of a key-sorted stream of record batches."""
    import pyarrow as pa
    import pyarrow.compute as pc

    waiting: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        last = keys[len(keys) - 1]
        cut = int(pc.index(keys, last).as_py())  # sorted: where the last group begins
        if waiting and waiting[-1].column(batch.schema.get_field_index(key))[-1] != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if cut:
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting)


def bounds_of(keys) -> np.ndarray:
    """Start of each group of a sorted key column, and the end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    if len(keys) < 2:
        return np.array([0, len(keys)])
    change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys)]])


def map_groups(df: DataFrame, key: str, order: list[str], run: Callable, schema: str) -> DataFrame:
    """run(table of whole groups, starts) gives an Arrow-compatible dict of columns; rows come sorted by key and order."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def over(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for part in groups_of(batches, key):
            columns = run(part, bounds_of(part.column(key)))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type, from_pandas=True) for f in arrow], schema=arrow)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(over, schema)


def large_groups(df: DataFrame, key: str, bound: int) -> DataFrame:
    """Key and n, the number of rows, of groups of more than `bound` rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > bound)


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with rn, each row's place in its key's order from 0, without gathering a key: a sort over ranges of (key, order), counts of each range, and offsets from those.

    Only one row for each key and range meets in a window. The sorted table is kept, so that numbers don't change when a task is repeated.
    """
    at = F.monotonically_increasing_id()  # partition number above, place in the partition below
    sorted_rows = keep(df.repartitionByRange(F.col(key), *map(F.col, order)).sortWithinPartitions(key, *order).withColumn("_at", at)).withColumn("_part", F.shiftright("_at", 33))
    parts = sorted_rows.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(key, "_part", "_first", before.alias("_before"))
    return sorted_rows.join(offsets, [key, "_part"]).withColumn("rn", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def chunked(df: DataFrame, key: str, order: list[str], bound: int, many: DataFrame | None = None) -> DataFrame:
    """df with chunk and core: groups of more than `bound` rows are cut along `order` into overlapping chunks of at most about `bound` rows.

    Cuts are made by row number, so rows equal in `order` are cut too, and there are as many chunks
    as a group's size asks for. A chunk is eight pieces and also gets the piece before and the piece
    after it with core = false, as context. Groups up to the bound stay chunk 0. The only extra cost
    without large groups is one count by key; many, if given, is its result, the larger groups' keys with n.
    """
    many = keep(large_groups(df, key, bound)) if many is None else many
    if many.isEmpty():
        return df.withColumn("chunk", F.lit(0)).withColumn("core", F.lit(True))
    size = max(1, bound // 10)
    small = df.join(many.select(key), key, "left_anti").select(*df.columns, F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("core"))
    large = numbered(df.join(many.select(key, F.col("n").alias("_n_rows")), key), key, order)
    piece, last = F.floor(F.col("rn") / size), F.floor((F.col("_n_rows") - 1) / size)
    mine = F.floor(piece / 8)
    copies = F.array_compact(
        F.array(
            F.struct(mine.alias("chunk"), F.lit(True).alias("core")),
            F.when((piece % 8 == 0) & (piece > 0), F.struct((mine - 1).alias("chunk"), F.lit(False).alias("core"))),
            F.when((piece % 8 == 7) & (piece < last), F.struct((mine + 1).alias("chunk"), F.lit(False).alias("core"))),
        )
    )
    return small.unionByName(large.withColumn("_copy", F.explode(copies)).select(*df.columns, "_copy.chunk", "_copy.core"))
