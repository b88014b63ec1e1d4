"""Tables in the folder that driver and executors share.

Writing a table there cuts lineage: a lost executor costs the tasks it ran,
never the steps before.  A ``scratch`` block removes what was written in it.
"""

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only an unset value on a plain
    local master is replaced, by a temporary folder of this machine."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="chronofact-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    for own in _blocks:
        own.append(path)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # the shuffle files of this step alone are of no more use
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


_blocks: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A block at whose end the tables that were ``saved`` in it are removed; what
    is wanted of them must have been written elsewhere by then."""
    own: list[str] = []
    _blocks.append(own)
    try:
        yield
    finally:
        _blocks[:] = [b for b in _blocks if b is not own]
        for path in own:
            remove(spark, path)
