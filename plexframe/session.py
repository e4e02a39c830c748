"""Session helpers: shared scratch tables and bounded broadcasts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) is a
    folder of our own chosen.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plexframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of scratch tables of this process that are still there, oldest first.
_ROOTS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(start: int = 0) -> None:
    """Deletes the folders of scratch tables made since there were ``start`` of them; nothing may read them any more."""
    for spark, root in _ROOTS[start:]:
        if spark.sparkContext._jsc is not None:  # a stopped session took its gateway along
            _delete(spark, root)
    del _ROOTS[start:]


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # the gateway may be gone by then
        release()


@contextmanager
def temporary() -> Iterator[None]:
    """Scratch tables made inside go at the end; whatever is kept of their data must be written elsewhere by then."""
    start = len(_ROOTS)
    try:
        yield
    finally:
        release(start)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's rows as a part of the plan; ``createDataFrame`` of a list would start Python workers of another kind on the executors, which stay."""
    kind = to_arrow_schema(T.DataType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], kind))


#: Bytes, as the plan estimates them, for each partition of ``dealt``.
DEALT_BYTES = 4 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over a stated number of partitions, which isn't coalesced by compressed size as an exchange's own would be: small rows of much work or memory."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = size if size < 1 << 50 else 0  # rows of a list have no estimate
    return df.repartition(max(spread, min(known // DEALT_BYTES, 20_000)), *keys)


#: Bytes that a writer of a scratch table holds back for one row group.
ROW_GROUP = 8 << 20


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    They stay for as long as a lazy result may read them: until ``drop``,
    the end of ``temporary`` or the end of the process.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/plexframe-{uuid.uuid4().hex}"
        self.n = 0
        _ROOTS.append((spark, self.root))

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self._path(name)
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        return self._read(path, df.schema)

    def split(self, df: DataFrame, by: str, kinds: dict[int, list[str]], name: str = "t") -> list[DataFrame]:
        """One pass over ``df`` written as one table per value of the int column ``by``, each with its own columns."""
        path, conf = self._path(name), "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(conf)
        self.spark.conf.set(conf, str(len(kinds)))  # a file per kind is open at once, so rows needn't be sorted by kind
        try:
            df.write.option("parquet.block.size", ROW_GROUP).partitionBy(by).parquet(path)
        finally:
            self.spark.conf.set(conf, before)
        out = []
        for kind, columns in kinds.items():
            own = f"{path}/{by}={kind}"
            jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
            jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jpath)  # a kind without rows has no folder yet
            out.append(self._read(own, df.select(*columns).schema))
        return out

    def _path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def _read(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def settle(self) -> None:
        """Has the driver collect its garbage: executors delete shuffle files only once their plans are found unreachable."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that ``write`` returned and nothing reads any more; others are left alone."""
        for df in tables:
            if df is not None and hasattr(df, "_scratch_path"):
                _delete(self.spark, df._scratch_path)
