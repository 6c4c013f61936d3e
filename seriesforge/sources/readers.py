"""Scans: files by suffix, whole folders, result documents, tables with soft deletes."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json"}


def scan(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """Read a file or folder; the suffix decides, and an unknown one is read as CSV.

    CSV and JSON take a schema to avoid a pass for inference.
    """
    fmt = fmt or FORMATS.get(PurePosixPath(path).suffix.lower(), "csv")
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.json(path, multiLine=True)
    return reader.csv(path, header=True, inferSchema=schema is None)


def load(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    """Register the file as a view of that name (replacing it) and return its schema."""
    df = scan(spark, path)
    df.createOrReplaceTempView(name)
    return dict(df.dtypes)


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> list[str]:
    """CSV and Parquet files of a folder in any file system that Spark reads; JSON is left out."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, recursive)
    found = []
    while files.hasNext():
        name = files.next().getPath().toString()
        if PurePosixPath(name).suffix.lower() in (".csv", ".parquet", ".pq"):
            found.append(name)
    return sorted(found)


def scan_directory(spark: SparkSession, folder: str, recursive: bool = True) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Frames by dataset name (the file's stem), and errors by path; one bad file stops no other."""
    frames, errors = {}, {}
    for path in list_files(spark, folder, recursive):
        try:
            frames[PurePosixPath(path).stem] = scan(spark, path)
        except Exception as e:  # a file that cannot be read is reported, not fatal
            errors[path] = str(e).splitlines()[0]
    return frames, errors


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def create_as(spark: SparkSession, name: str, df: DataFrame) -> int:
    """Register ``df`` as a view of that name and return its number of rows."""
    df.createOrReplaceTempView(name)
    return spark.table(name).count()


def profile_directory(spark: SparkSession, folder: str, recursive: bool = True) -> tuple[DataFrame | None, dict[str, str]]:
    """dataset, column, kind, n_distinct, n_null, role of every file's columns, and errors by path."""
    from ..operators.profile import roles, union_all

    frames, errors = scan_directory(spark, folder, recursive)
    parts = [roles(df).select(F.lit(name).alias("dataset"), "*") for name, df in sorted(frames.items())]
    return (union_all(parts) if parts else None), errors


def sample(df: DataFrame, n: int = 5000) -> DataFrame:
    return df.limit(n)


def live_rows(df: DataFrame, deleted: str) -> DataFrame:
    """Rows whose deletion flag is not true; a null flag is not true."""
    return df.where(~F.col(deleted).eqNullSafe(F.lit(True)))


def result_documents(spark: SparkSession, path: str, list_field: str) -> DataFrame:
    """One row per element of a list field of JSON result documents."""
    return spark.read.json(path, multiLine=True).select(F.explode(list_field).alias("item")).select("item.*")


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """path, md5: for change detection."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def dataset_descriptor(spark: SparkSession, path: str) -> dict:
    """The optional YAML descriptor beside a dataset: domain, geography, currency."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path).collect())  # a short configuration file
    found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found
