"""Sessions and table loading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session; on a cluster, pass your own session to everything here."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("nestwell")
    base = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    return b.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession, name: str) -> str:
    """A folder for a store that lasts as long as this driver: below ``spark.checkpoint.dir``, or a temporary one in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="nestwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    root = f"{found.rstrip('/')}/nestwell/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(root)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended
            return

    atexit.register(remove)
    return root
