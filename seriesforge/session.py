"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master that names none, as in tests,
    gets a temporary one; elsewhere that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="shared-")
        _LOCAL[sc.applicationId] = root
    return root.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so its lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by its keys over all shuffle partitions, a fixed number: AQE would size tasks by the packed bytes they
    read, though they hold or make far more. A grouping by the keys that follows needs no partial one before, whose
    tasks are as large as the files."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def get_session(app: str = "seriesforge", **settings: str) -> SparkSession:
    """A session with the engine's settings; keyword names use __ for dots."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
