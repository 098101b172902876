"""Reading the named tables, and keeping intermediate tables where every executor sees them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}
_KEPT: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset (tests on one machine) a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_FOLDER[app] = f"file://{tempfile.mkdtemp(prefix='weft-')}"
        atexit.register(_remove_own, app)
    return _OWN_FOLDER[app]


def _remove_own(app: str) -> None:
    import shutil

    shutil.rmtree(_OWN_FOLDER[app].removeprefix("file://"), ignore_errors=True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file on any file system that the session knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def keep(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage: readers survive the loss of any executor, and Python
    stages upstream run once however often the table is read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weft-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if not _KEPT:
        atexit.unregister(release)
        atexit.register(release)  # last registered runs first: the session is still there
    _KEPT.append((spark, path))
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def release(count: int = 0) -> None:
    """Delete kept tables written so far, but for the last `count`; for loops that replace their state."""
    while len(_KEPT) > count:
        drop(_KEPT.pop(0))


@contextmanager
def scope():
    """Kept tables written within are deleted at the end: for a caller that has written a query's rows and needs nothing of it any more."""
    before = len(_KEPT)
    try:
        yield
    finally:
        for entry in _KEPT[before:]:
            drop(entry)
        del _KEPT[before:]


def drop(entry: tuple[SparkSession, str]) -> None:
    spark, path = entry
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is then the cluster's to clean
        pass


def kept_path(df: DataFrame) -> str:
    """The folder that a kept table was read from."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def forget(df: DataFrame) -> None:
    """Delete one kept table at once."""
    path = kept_path(df) if df.inputFiles() else ""
    for e in list(_KEPT):
        if path and path.split("weft-")[-1].startswith(e[1].split("weft-")[-1]):
            _KEPT.remove(e)
            drop(e)


def dimension(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df with a broadcast hint, after a check that it has at most `most` rows."""
    from pyspark.sql import functions as F

    if df.limit(most + 1).count() > most:
        raise ValueError(f"a dimension of more than {most} rows isn't broadcast")
    return F.broadcast(df)
