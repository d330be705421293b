"""Written tables in the shared folder: how the operators cut lineage.

Every intermediate result that is read more than once goes to Parquet under
``spark.checkpoint.dir``, which all executors share, so a lost executor costs
a re-read and never a lost block.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import small_batches


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a new local folder is used, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodeseek-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete a query's shuffle files when the query has ended; what later queries read is written as tables."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Workspace:
    """A folder of written tables that belongs to one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        drop_shuffles(spark)
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._lodeseek_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for t in tables:
            path = getattr(t, "_lodeseek_path", None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def _at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
                self._delete(self.root)
        except Exception:  # the session may be gone; the folder is then left to its owner
            pass
