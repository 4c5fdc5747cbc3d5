"""What the operators of this package share: the cluster's shared folder, and bytes out of Arrow columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"


#: Paths of the tables that cut() wrote and nobody has removed yet, each with its session.
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, as in tests, one of this machine's own if Spark runs on it alone; else it is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillmask-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, and a lost executor costs nothing. The table goes with drop(), release() or the end of the program."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quillmask-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmask_path = path
    return out


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Remove the table behind a DataFrame made by cut() that nothing reads any more."""
    if path := getattr(df, "_quillmask_path", None):
        _remove(path)


@contextmanager
def release(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """What the block writes by cut() is removed behind it, but for the tables of the DataFrames that it puts into the list. For results that have been written or collected within the block."""
    before, keep = set(_written), [*kept]
    yield keep
    paths = {getattr(df, "_quillmask_path", None) for df in keep}
    for path in [x for x in _written if x not in before and x not in paths]:
        _remove(path)


@atexit.register
def _remove_all() -> None:
    for path in [*_written]:
        try:
            _remove(path)
        except Exception:  # the session has ended: there is nobody left to ask
            _written.clear()


def raw(column: pa.Array, at_once: int = 500) -> Iterator[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them; so many are copied out of the batch at once."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for at in range(0, len(column), at_once):
        yield from column.slice(at, at_once).to_pylist()


def looked_up(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, most: int = 1000) -> DataFrame:
    """rows joined with keyed (one row a key, with ``n``, how many of the ``total`` rows have it, which goes). Keys of more than a thousandth of the rows, fewer than ``most`` by arithmetic, are looked up by broadcast, so that their rows stay where they are; all
    others meet in a shuffle, of at most that many rows a key."""
    hot = F.col("n") * most > total
    few = F.broadcast(keyed.where(hot).drop("n"))
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(keyed.where(~hot).drop("n"), on))


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
