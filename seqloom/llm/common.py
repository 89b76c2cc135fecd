"""Shared helpers: the shared folder, staged tables, checked broadcasts, table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size stays below this.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where it is unset, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_WORKER: dict[tuple, object] = {}


def clear_worker() -> None:
    """Forget what this Python worker kept for another operator, and give the memory back."""
    import ctypes
    import gc

    if not _WORKER:
        return
    _WORKER.clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: the allocator gives memory back as it likes
        pass


def worker_state(key: tuple, build):
    """What a Python worker keeps from task to task. It keeps one thing only: another operator's state goes first."""
    if key not in _WORKER:
        clear_worker()
        _WORKER[key] = build()
    return _WORKER[key]


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Texts are long: send them to Python workers in batches of at most this many rows, unless the session has fewer."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, str(rows))


_STAGED: list[tuple[SparkSession, str]] = []


@atexit.register
def release() -> None:
    """Delete every staged table of this process; results that still read them must be written first."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone already
            continue


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its measured size is below BROADCAST_BYTES, else df as it is (a shuffle join).

    The size is that of the rows, row_bytes each, and of the texts in them.
    """
    if rows is not None:
        size = rows * row_bytes
    else:
        texts = [F.sum(F.length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
        got = df.agg(F.count(F.lit(1)), *texts).first()
        size = got[0] * row_bytes + sum(x or 0 for x in got[1:])
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    """A hash that tells the texts of rows with one id apart."""
    return F.xxhash64(text)


def without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df but those whose id and text_key are in gone(id, th). Null ids are ids like any other."""
    a, b = fresh(df, "gone_id"), fresh(df, "gone_th")
    gone = stage(gone.select(F.col("id").alias(a), F.col("th").alias(b)).distinct(), "gone")
    return df.join(bounded(gone, 64), F.col(id_col).eqNullSafe(F.col(a)) & (text_key(F.col(text_col)) == F.col(b)), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(id_col: str | Column) -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def held_out(id_col: str | Column, modulus: int, remainder: int) -> Column:
    return F.pmod(crc_of(id_col), F.lit(modulus)) == remainder
