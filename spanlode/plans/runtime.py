"""Session settings, lineage cuts and hot-key helpers that operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate results, named in ``spark.checkpoint.dir``. Where that is
    unset, a temporary one in local mode, as in tests; on a cluster an error, as no machine's own folder would do."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _temporary()
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
        _forget_at_exit(spark, context._jsc.sc().getCheckpointDir().get())  # a folder of this program's own below it
    return base.rstrip("/")


@lru_cache(maxsize=1)
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    if not _WRITTEN:
        atexit.register(_delete_written)
    _WRITTEN.append((spark, path))


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, so later reads don't run its plan again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder: smaller than a checkpoint where values repeat, and later reads take
    the columns they need. The table is deleted when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
    df.write.parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_written() -> None:
    for spark, path in _WRITTEN:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S110 - the session has ended before
            pass


def local_session(app: str = "spanlode", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the queries are tested under."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def salt_of(*cols: str, salts: int):
    """A salt in [0, salts) that depends on the row's values only, so a retried task deals alike."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def share_package(spark: SparkSession) -> None:
    """Lets Python workers on this host find the package when it runs from a checkout; installed copies are not touched."""
    home = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, home])
