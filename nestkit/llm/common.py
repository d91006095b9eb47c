"""What the operators of this folder share: tables, scratch tables in the shared folder, word rules, column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One word of the contracts: a run of anything but space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table goes to every task only if its rows, as they lie in memory, are within so many bytes.
SMALL = 16 << 20
#: Bytes of a row in a hashed relation besides its columns.
ROW = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only. Pure ASCII takes the fast built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id as text falls into a fold; a null id is in none."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that docs does not have."""
    mark = uuid.uuid4().hex[:12]
    return [f"_{mark}_{n}" for n in names]


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bounds an Arrow batch by rows and by bytes, so that a Python worker's memory does not follow the texts' lengths.
    These are settings of the session, read when a job starts. What a function returns is not split: its batches are as
    long as those it reads, or bounded by itself, and Spark 4.1.2 fails or repeats rows where it splits them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerOutputBatch", "-1")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerOutputBatch", "-1")


def _width(kind: T.DataType) -> int:
    """Bytes of a value, with 64 for one of no fixed size."""
    return 16 if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else 64


class Scratch:
    """Tables written to the folder that spark.checkpoint.dir names, which all executors share.

    A written table cuts the lineage and survives a lost executor. Without the setting a local run takes a temporary
    folder; a cluster must have it. Tables go with drop() and only(), and the rest when the JVM ends.
    """

    local: dict[str, str] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            app = spark.sparkContext.applicationId
            base = Scratch.local.setdefault(app, Scratch.local.get(app) or tempfile.mkdtemp(prefix="nestkit-"))
        self.root = f"{base.rstrip('/')}/nestkit-{uuid.uuid4().hex}"
        self.n = 0
        self.live: dict[str, None] = {}

    def _fs(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf), at

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        if self.n == 1:
            fs, at = self._fs(self.root)
            fs.deleteOnExit(at)
        self.live[path] = None
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def small(self, df: DataFrame, limit: int = SMALL, of: DataFrame | None = None) -> DataFrame:
        """A saved table, or rows of the saved table of, marked for broadcast only if its rows are within the limit by
        their number and width; else Spark shuffles for it. The number comes from the files' footers."""
        whole = df if of is None else of
        width = ROW + sum(_width(f.dataType) for f in df.schema.fields)
        fs, at = self._fs(whole._scratch_path)
        # A file of this size compressed is beyond the limit in any case.
        if fs.getContentSummary(at).getLength() > limit:
            return df
        return F.broadcast(df) if self.spark.read.parquet(whole._scratch_path).count() * width <= limit else df

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this scratch that nothing reads any more."""
        for df in tables:
            fs, at = self._fs(df._scratch_path)
            fs.delete(at, True)
            self.live.pop(df._scratch_path, None)

    def only(self, *tables: DataFrame) -> None:
        """Deletes all tables of this scratch but those that the result reads."""
        keep = {df._scratch_path for df in tables}
        for path in [p for p in self.live if p not in keep]:
            fs, at = self._fs(path)
            fs.delete(at, True)
            del self.live[path]
