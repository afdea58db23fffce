"""Session, shared-folder and code-shipping helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tokenloom")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir where the session
    names one. A folder of our own only on a single machine (master local[...], tests):
    on a cluster executors would write to disks of their own, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        folder = tempfile.mkdtemp(prefix="tokenloom-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(f"file://{folder}/checkpoints")
        _OWN_DIRS[app] = f"file://{folder}"
    return _OWN_DIRS[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing df as parquet into the shared folder and reading it
    back. Compressed and columnar, so smaller than checkpoint(); survives the loss of
    any executor. The folder is removed when the Spark application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tokenloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan that a Python stage follows, over as many partitions as there are cores. A
    table of at least so many partitions stays as it is: only tables that are small
    against the cluster, or lie in one file that cannot be split, are exchanged."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tokenloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "tokenloom_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
