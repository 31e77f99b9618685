"""Session settings and the shared folder in which jobs cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def get_spark(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings that every query assumes: UTC, AQE, Arrow."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(master).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one on a local master, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once into the shared folder and read it back, so that later jobs survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(seen: Observation) -> dict:
    """What an observation saw; nothing where the optimiser found the observed plan to be empty and left it out."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through the Hadoop file system that holds it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def width(spark: SparkSession) -> int:
    """Shuffle partitions in force: the parallelism that hand-made blocks follow."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
