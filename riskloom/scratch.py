"""Shared working tables: Parquet in the folder that every executor sees."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; a cluster has no
    safe default, so that is an error.
    """
    root = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {KEY} to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="riskloom-")
    spark.conf.set(KEY, root)
    return root


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_riskloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="riskloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    root = Path(__file__).resolve().parent
    context.addPyFile(shutil.make_archive(f"{folder}/riskloom", "zip", root.parent, root.name))
    context._riskloom_shipped = True


class Scratch:
    """Written and reread tables that cut lineage; lost executors cost a reread only.

    ``put`` writes a table now. ``free`` deletes one that nothing reads any more;
    the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """by: a last column of few values; its rows lie in a folder each, which filters on it prune."""
        path = self.path(name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self._paths.pop(id(t), None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            pass
