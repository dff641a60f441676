"""Tables that one step writes and later steps read: in the folder that driver and executors share, deleted when done."""
from __future__ import annotations

import atexit
import re
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder that the caller set; in local mode the warehouse stands in.

    Outside local mode a missing setting raises, as a folder of one machine would be missed by the others.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not re.fullmatch(r"local(\[[\d*,]+\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/emberlane-scratch"


class Scratch:
    """``with Scratch(spark) as s``: ``s.keep(df)`` writes a table and reads it back, which also cuts its lineage.

    All tables go at the end of the block, so what leaves it must not read them; ``s.drop(df)`` deletes one sooner. Without
    ``with``, for tables behind a result that is yet to be read, they go when the driver ends.
    """

    _open: dict[str, Scratch] = {}

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self._at: dict[int, str] = {}
        Scratch._open[self.folder] = self

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.close()

    def close(self) -> None:
        if Scratch._open.pop(self.folder, None) is not None and self.spark.sparkContext._jsc is not None:
            self._delete(self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._at[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(self._at.pop(id(df)))

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _close_all() -> None:
    for scratch in list(Scratch._open.values()):
        scratch.close()
