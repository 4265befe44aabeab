"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = "/root/testdata"  # where the driver keeps the tables of the bench and the checks
TEST_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"  # a byte-pair vocabulary for the registered queries
_CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "textfacts") -> SparkSession:
    """A session for tests and the bench; on a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TEXTFACTS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


@cache
def _own_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="textfacts-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder named by ``spark.checkpoint.dir``.

    A folder of its own is made only for local sessions that name none, and goes
    when the process ends; on a cluster every executor must see the folder, so
    there the setting is required.
    """
    root = spark.conf.get(_CHECKPOINT_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_SETTING} to a folder all executors share")
        root = _own_folder(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Unlike a cached plan this survives lost executors, and later passes read
    only the columns they need.  ``options`` are the writer's.
    """
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
