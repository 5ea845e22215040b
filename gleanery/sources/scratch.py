"""Tables written once and read by several branches of a plan, and where they lie."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a folder is made here if none is named; on a
    cluster a machine's own folder would lose tables, so that is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="gleanery-"))
        spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/gleanery/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def mark() -> int:
    """Where the list of scratch paths ends now; for :func:`drop_since`."""
    return len(_made)


def drop_since(start: int, *keep: str) -> None:
    """Remove the scratch tables made since :func:`mark`: their readers are done, or are those of ``keep``."""
    for spark, path in [x for x in _made[start:] if x[1] not in keep]:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    _made[:] = [x for x in _made if x[1] != path]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _status(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _status(spark, path)
    return store.exists(where)


def stamp_of(df: DataFrame) -> tuple:
    """Path, time and size of the files that ``df`` reads (of their folders if they are many); empty if there are none."""
    files = df.inputFiles()
    if len(files) > 100:
        files = {f.rsplit("/", 1)[0] for f in files}
    out = []
    for path in sorted(files):
        where, store = _status(df.sparkSession, path)
        status = store.getFileStatus(where)
        out.append((path, status.getModificationTime(), status.getLen()))
    return tuple(out)


def _sweep() -> None:
    for spark, path in list(_made):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
            return


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
