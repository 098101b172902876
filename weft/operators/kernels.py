"""Kernel (Gram) matrices as long tables: kernel_id, i, j, k.

Kernels between vectors are made for a stated set of queries against all rows: the
query set is broadcast in blocks of a bounded size and every batch of rows is one
matrix product, so nothing is shuffled. Kernels with few, fixed rows (moments of
dimensions, categories) are sums, made map-side first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query vectors in one broadcast block.
BLOCK = 4_096


def _vectors(column) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _cosine(q, x, **_):
    a, b = np.linalg.norm(q, axis=1, keepdims=True), np.linalg.norm(x, axis=1)
    return (q @ x.T) / np.where(a == 0, 1, a) / np.where(b == 0, 1, b)


def _sq_dist(q, x):
    return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T, 0)


KERNELS = {
    "linear": lambda q, x, **_: q @ x.T,
    "cosine": _cosine,
    "rbf": lambda q, x, length_scale=1.0, **_: np.exp(-_sq_dist(q, x) / (2 * length_scale**2)),
    "poly": lambda q, x, degree=3, coef0=1.0, **_: (q @ x.T + coef0) ** degree,
    "hamming_rbf": lambda q, x, threshold=0.5, sigma=1.0, **_: np.exp(-_sq_dist((q > threshold).astype(float), (x > threshold).astype(float)) / (2 * sigma**2)),
    "hellinger": lambda q, x, **_: np.sqrt(np.maximum(q, 0)) @ np.sqrt(np.maximum(x, 0)).T,
    "anisotropic": lambda q, x, scales=None, variance=1.0, **_: variance * np.exp(-0.5 * _sq_dist(q / np.asarray(scales), x / np.asarray(scales))),
}


def gram(queries: DataFrame, rows: DataFrame, kind: str | object, id_col: str = "id", vec_col: str = "vec", block: int = BLOCK, **params) -> DataFrame:
    """i, j, k: kernel of each query against each row.

    kind names one of KERNELS or is a function of two matrices. Null vectors and vectors of
    another length than the first query's are left out; ids (whole numbers or strings) may repeat;
    empty tables give none.
    """
    spark, fn = rows.sparkSession, KERNELS[kind] if isinstance(kind, str) else kind
    id_type = "string" if dict(rows.dtypes)[id_col] == "string" else "long"
    known = queries.where(f"{vec_col} is not null").select(F.col(id_col).cast(id_type).alias("i"), F.col(vec_col).cast("array<double>").alias("v"))
    source = rows.where(f"{vec_col} is not null").select(F.col(id_col).cast(id_type).alias("j"), F.col(vec_col).cast("array<double>").alias("v"))

    def against(ids, matrix):
        shared = spark.sparkContext.broadcast((np.array(ids, object if id_type == "string" else "int64"), np.array(matrix)))

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            own, q = shared.value
            for batch in batches:
                for a in range(0, len(batch), 1024):
                    part = batch.slice(a, 1024)
                    part = part.filter(pc.equal(pc.list_value_length(part.column(1)), q.shape[1]))
                    if not len(part):
                        continue
                    k = fn(q, _vectors(part.column(1)), **params)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(part))), pa.array(np.tile(part.column(0).to_numpy(zero_copy_only=False), len(own))), pa.array(k.ravel())], names=["i", "j", "k"])

        return source.mapInArrow(run, f"i {id_type}, j {id_type}, k double")

    out, ids, matrix = None, [], []
    for r in known.toLocalIterator():
        if matrix and len(r.v) != len(matrix[0]):
            continue
        ids.append(r.i), matrix.append(r.v)
        if len(ids) == block:
            out = against(ids, matrix) if out is None else out.unionByName(against(ids, matrix))
            ids, matrix = [], []
    if ids:
        out = against(ids, matrix) if out is None else out.unionByName(against(ids, matrix))
    return out if out is not None else source.select(F.lit(0).cast(id_type).alias("i"), "j", F.lit(0.0).alias("k")).where(F.lit(False))


def moment_kernels(rows: DataFrame, group: str, vec_col: str = "vec") -> DataFrame:
    """kernel_id, i, j, k: the second moment between dimensions of each group's vectors, X'X / n. Summed within batches before the shuffle."""
    source = rows.where(f"{group} is not null and {vec_col} is not null").select(F.col(group).cast("string").alias("g"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, x = np.array(batch.column(0).to_pylist(), dtype=object), _vectors(batch.column(1))
            for g in dict.fromkeys(keys):
                m = x[keys == g]
                d = m.shape[1]
                i, j = np.divmod(np.arange(d * d), d)
                yield pa.RecordBatch.from_arrays([pa.array([g] * (d * d)), pa.array(i), pa.array(j), pa.array((m.T @ m).ravel()), pa.array(np.full(d * d, len(m)))], names=["kernel_id", "i", "j", "s", "n"])

    parts = source.mapInArrow(run, "kernel_id string, i long, j long, s double, n long")
    return parts.groupBy("kernel_id", "i", "j").agg((F.sum("s") / F.sum("n")).alias("k"))


def kernel_sum(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0, keys: tuple = ("i", "j")) -> DataFrame:
    """alpha*A + beta*B, cell by cell; weights must not be negative, so that the sum stays positive semi-definite."""
    if alpha < 0 or beta < 0:
        raise ValueError("weights of a kernel sum must not be negative")
    both = a.select(*keys, (F.col("k") * alpha).alias("k")).unionByName(b.select(*keys, (F.col("k") * beta).alias("k")))
    return both.groupBy(*keys).agg(F.sum("k").alias("k"))


def kernel_product(a: DataFrame, b: DataFrame, keys: tuple = ("i", "j")) -> DataFrame:
    """A times B, cell by cell."""
    return a.select(*keys, F.col("k").alias("ka")).join(b.select(*keys, F.col("k").alias("kb")), list(keys)).select(*keys, (F.col("ka") * F.col("kb")).alias("k"))


def normalise(kernel: DataFrame) -> DataFrame:
    """k_ij / sqrt(k_ii k_jj); a zero diagonal counts as one."""
    diagonal = kernel.where("i = j").select("kernel_id", "i", F.when(F.col("k") == 0, 1.0).otherwise(F.sqrt("k")).alias("d"))
    left = diagonal.select("kernel_id", "i", F.col("d").alias("di"))
    right = diagonal.select("kernel_id", F.col("i").alias("j"), F.col("d").alias("dj"))
    return kernel.join(left, ["kernel_id", "i"]).join(right, ["kernel_id", "j"]).select("kernel_id", "i", "j", (F.col("k") / F.col("di") / F.col("dj")).alias("k"))


def hs_norm(kernel: DataFrame) -> DataFrame:
    """kernel_id, n, norm: the Frobenius norm over the root of the number of rows."""
    return kernel.groupBy("kernel_id").agg((F.max("i") + 1).alias("n"), (F.sqrt(F.sum(F.col("k") * F.col("k"))) / F.sqrt(F.max("i") + 1)).alias("norm"))


#: Kernels that may be compared all with all.
MOST_KERNELS = 5_000


def few_kernels(kernel: DataFrame) -> None:
    if kernel.select("kernel_id").distinct().limit(MOST_KERNELS + 1).count() > MOST_KERNELS:
        raise ValueError(f"more than {MOST_KERNELS} kernels aren't compared all with all: state which are queries and use gram()")


def hs_distances(kernel: DataFrame) -> DataFrame:
    """a, b, distance of each pair a < b of kernels of the same size.

    Kernels are few by nature (one each group or frame) and their number is checked, as pairs grow with its
    square; cells meet by one join on (i, j).
    """
    few_kernels(kernel)
    left, right = kernel.select(F.col("kernel_id").alias("a"), "i", "j", F.col("k").alias("ka")), kernel.select(F.col("kernel_id").alias("b"), "i", "j", F.col("k").alias("kb"))
    d = F.col("ka") - F.col("kb")
    return left.join(right, ["i", "j"]).where("a < b").groupBy("a", "b").agg((F.sqrt(F.sum(d * d)) / F.sqrt(F.max("i") + 1)).alias("distance"))


def loop_closures(distances: DataFrame, k: int) -> DataFrame:
    """The k most alike pairs: similarity 1 / (1 + distance)."""
    return distances.select("a", "b", (1 / (1 + F.col("distance"))).alias("similarity")).orderBy(F.desc("similarity"), "a", "b").limit(k)


def prototypes(rows: DataFrame, label: str, vec_col: str = "vec") -> DataFrame:
    """label, vec, n: mean vector of each label."""
    spread = rows.where(f"{label} is not null").select(F.col(label).alias("label"), F.posexplode(F.col(vec_col).cast("array<double>")).alias("d", "x"))
    return spread.groupBy("label", "d").agg(F.avg("x").alias("x"), F.count("*").alias("n")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda c: c["x"]).alias("vec"), F.max("n").alias("n"))


def classify(rows: DataFrame, protos: DataFrame, id_col: str, vec_col: str, least: float = 0.5, unsure: float = 0.75) -> DataFrame:
    """id, label, similarity, status of the nearest prototype by cosine; first label wins ties.

    status is 'known' from `unsure` on, 'uncertain' from `least` on, else 'unknown'. Prototypes go out in blocks
    of BLOCK; with more than one block each row keeps the best of each, and then of all.
    """
    spark = rows.sparkSession
    source = rows.where(f"{vec_col} is not null").select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def near(labels, matrix):
        shared = spark.sparkContext.broadcast((np.array(labels), np.array(matrix)))

        def run(batches):
            import pyarrow as pa

            own, q = shared.value
            for batch in batches:
                k = _cosine(q, _vectors(batch.column(1)))
                best = k.argmax(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own[best], pa.int32()), pa.array(k[best, np.arange(len(best))])], names=["id", "label", "similarity"])

        return source.mapInArrow(run, "id long, label int, similarity double")

    found, labels, matrix = [], [], []
    for r in protos.select("label", "vec").orderBy("label").toLocalIterator():
        labels.append(r.label), matrix.append(r.vec)
        if len(labels) == BLOCK:
            found.append(near(labels, matrix))
            labels, matrix = [], []
    if labels:
        found.append(near(labels, matrix))
    if not found:
        return source.select("id", F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("similarity"), F.lit("unknown").alias("status"))
    best = found[0]
    if len(found) > 1:
        every = reduce(DataFrame.unionByName, found)
        best = every.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("label")).alias("first"))).alias("m")).select("id", (-F.col("m.first")).alias("label"), "m.similarity")
    return best.withColumn("status", status(F.col("similarity"), least, unsure))


def status(similarity: Column, least: float, unsure: float) -> Column:
    return F.when(similarity >= unsure, "known").when(similarity >= least, "uncertain").otherwise("unknown")


def distributions(rows: DataFrame, key: str, category: str, weight: Column | None = None) -> DataFrame:
    """key, category, p: share of each category within each key."""
    counts = rows.where(f"{key} is not null and {category} is not null").groupBy(key, category).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    return counts.join(totals, key).select(key, category, (F.col("n") / F.col("total")).alias("p"))


#: Categories that distributions compared as vectors may have.
MOST_CATEGORIES = 10_000


def hellinger(queries: DataFrame, all_rows: DataFrame, key: str, category: str) -> DataFrame:
    """a, b, affinity, hellinger, fisher_rao of each query key with every key that shares a category.

    Categories are a dimension of checked size: each key's distribution becomes one vector over them, and
    the queries, a stated set, meet all vectors in blocks, so no category gathers its keys. Affinities
    within 1e-9 of one are one, as sums of rounded shares can't tell them apart.
    """
    names = [r[0] for r in all_rows.select(category).where(F.col(category).isNotNull()).distinct().orderBy(category).limit(MOST_CATEGORIES + 1).collect()]
    if len(names) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    place = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))) if names else F.lit(None)

    def vectors(rows: DataFrame) -> DataFrame:
        cells = rows.where(F.col(category).isin(names)).select(F.col(key).alias("id"), place[F.col(category)].alias("at"), "p")
        held = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "p"))).alias("m"))
        return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))

    if not names:
        empty = all_rows.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("affinity")).where(F.lit(False))
    else:
        empty = gram(vectors(queries), vectors(all_rows), "hellinger").where("k > 0").select(F.col("i").alias("a"), F.col("j").alias("b"), F.when(F.col("k") >= 1 - 1e-9, 1.0).otherwise(F.col("k")).alias("affinity"))
    return empty.select("a", "b", "affinity", F.sqrt(1 - F.col("affinity")).alias("hellinger"), (2 * F.acos("affinity")).alias("fisher_rao"))
