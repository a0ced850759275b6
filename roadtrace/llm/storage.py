"""Shared-folder files, Arrow batch limits and skew-safe joins used by every operator."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; with texts of tens of kB a batch stays in the tens of MB.
BATCH_ROWS = 1000


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="roadtrace-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a temporary folder is taken in local mode; on a
    cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


#: Folders made by this driver that are still there, oldest first.
_made: list[str] = []


def release(paths: list[str] | None = None) -> None:
    """Delete folders of ``shared_folder`` (all that this driver made, if none are named). DataFrames that read them are of no use afterwards."""
    for path in list(_made) if paths is None else paths:
        if path in _made:
            _made.remove(path)
        fs, inner = open_fs(path)
        if fs.get_file_info(inner).is_file:
            fs.delete_file(inner)
        elif fs.get_file_info(inner).type.name == "Directory":
            fs.delete_dir(inner)


@contextlib.contextmanager
def scratch(*keep: str):
    """Delete the shared folders that were made inside the block, but ``keep``: for a block whose result is written or collected in it.

    An operator's DataFrame reads tables in the shared folder until its rows have been
    taken, so only the caller knows when they can go.
    """
    before = set(_made)
    try:
        yield
    finally:
        release([p for p in _made if p not in before and p not in keep])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that long texts fit in a Python worker.

    Spark reads the setting when a query starts, after its operator has returned; so
    it stays lowered in the session. A lower setting of the caller's own stays as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def open_fs(uri: str):
    """The pyarrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_committed(uri: str, data: list[bytes]) -> None:
    """Write under a temporary name, then rename: a reader never sees half a file.

    A repeated task writes the same bytes; where the store does not rename onto an
    existing file, the earlier one stays.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        for part in data:
            out.write(part)
    try:
        fs.move(temporary, path)
    except OSError:
        if not fs.get_file_info(path).is_file:
            raise
        fs.delete_file(temporary)


def read_file(uri: str, start: int = 0, length: int | None = None) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()


def partitions_for(spark: SparkSession, n_bytes: int, per_task: int = 24 << 20) -> int:
    """Partitions of about ``per_task`` bytes, at least the session's default parallelism."""
    return max(spark.sparkContext.defaultParallelism, -(-int(n_bytes or 0) // per_task))


def hot_limit(total: int) -> int:
    """Rows from which a key counts as hot: at most 2000 keys can reach it, which bounds their broadcast."""
    return max(50, total // 2000)


def join_hot(big: DataFrame, small: DataFrame, key: str, count: str, total: int, values: list[str]) -> DataFrame:
    """Left join ``big`` to ``small`` (one row per ``key``) where a key may hold a third of ``big``.

    ``small[count]`` is the number of rows of ``big`` with the key. Keys of more
    than ``hot_limit(total)`` rows number at most 2000, so they are broadcast;
    rows of such keys take part in the shuffle with a scattered key that finds no partner.
    ``small`` should be materialized, as it is read twice. Null keys find no partner.
    """
    limit = hot_limit(total)
    hot = small.where(F.col(count) > limit).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    cold = small.where(F.col(count) <= limit).select(F.col(key).alias("_ck"), F.lit(0).alias("_cs"), F.struct(*values).alias("_cv"))
    out = big.join(F.broadcast(hot), big[key] == F.col("_hk"), "left")
    out = out.withColumn("_salt", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), 0).otherwise((F.rand(7) * 1e6).cast("int") + 1))
    out = out.join(cold, (out[key] == F.col("_ck")) & (out["_salt"] == F.col("_cs")), "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(F.col(f"_hv.{v}"), F.col(f"_cv.{v}")))
    return out.drop("_hk", "_hv", "_ck", "_cs", "_cv", "_salt")
