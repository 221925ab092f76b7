"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back, so that a
lost executor costs a re-read and never a recomputation of everything before it.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from framelight.ship import ship

#: On a mounted folder Hadoop starts processes (chmod) for each file and its checksum file, and each start copies
#: the executor's page tables.  Parquet files of a run need no second file, so the plain file system writes them.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset and everything is one process, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="framelight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables of one run.  ``save`` writes and rereads; ``drop`` removes what is no longer read; the rest goes with the process."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**_PLAIN_FILES).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")
            self.names.discard(name)

    def _delete(self, at: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Removes all tables of the run."""
        with contextlib.suppress(Exception):  # at exit the session may be gone, and the folder with it
            self._delete(self.root)
        self.names.clear()
        atexit.unregister(self.clear)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of texts hold about ``size`` bytes, however long the texts; workers can import the package.

    The setting is read when a frame runs, which is after this call, so the session keeps it.  It is only
    ever lowered, so the order of calls does not matter.
    """
    ship(spark)
    now = re.fullmatch(r"(\d+)b?", str(spark.conf.get(_BATCH)).lower())
    if not now or int(now[1]) > size:
        spark.conf.set(_BATCH, size)
