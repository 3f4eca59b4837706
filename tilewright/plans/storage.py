"""Written intermediate tables in the folder all executors share.

Iterative and two-level operators cut their lineage here.  The folder is the
one the session names in ``spark.checkpoint.dir``; only where that is unset and
everything runs in one JVM (tests, a laptop) a private temporary folder is made,
one per application.  On a cluster without the setting it is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a private one only where none is set."""
    path = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{_KEY} must name a folder that all executors share")
    if not path:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        path = _own[app]
    return path.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader on it.

    The written table survives the loss of any executor, and whatever reads
    it twice does not compute ``df`` twice.  It is removed by ``discard``, or
    when the driver that wrote it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilewright-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    made = spark.read.schema(df.schema).parquet(path)
    made._tilewright_path = path
    return made


def discard(made: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote; nothing that still has to run may read it."""
    path = getattr(made, "_tilewright_path", None)
    if path:
        spark = made.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
