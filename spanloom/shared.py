"""Places and cuts that survive the loss of executors.

Tables that a lazy result still reads can't be removed when an operator returns. What an operator has used up it releases itself; the
rest goes when the enclosing :func:`scope` ends, or with the session.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, a single machine) a temporary folder of our own is set and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spanloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint: the lineage ends in files of the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table into the shared folder and return the table.

    Unlike :func:`cut` the rows are columnar and compressed, so later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove, 0)
    _WRITTEN[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._spanloom_path = path
    return table


def written_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` gives, written; the tables that it wrote on the way are removed."""
    before = set(_WRITTEN)
    table = written(build(), name)
    for path in set(_WRITTEN) - before - {table._spanloom_path}:
        _delete(path)
    return table


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        _delete(t._spanloom_path)


@contextmanager
def scope() -> Iterator[None]:
    """All tables written inside are removed at its end. Results must have been taken or written elsewhere by then."""
    began = len(_WRITTEN)
    try:
        yield
    finally:
        _remove(began)


def _remove(began: int) -> None:
    for path in list(_WRITTEN)[began:]:
        _delete(path)


def _delete(path: str) -> None:
    _drop(_WRITTEN.pop(path, None), path)


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which goes with the session and not with a scope."""
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession | None, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; then the shared folder's owner cleans up
        pass
