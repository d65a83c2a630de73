"""Table sources: one Parquet file or folder per table under a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``; columns and filters applied later reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_kind(spark: SparkSession, path: str) -> str | None:
    """'folder', 'file', or null if there is nothing, as the file system of the path (local, hdfs, object store) says."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    return "folder" if fs.getFileStatus(where).isDirectory() else "file"


def read_exam_files(spark: SparkSession, path: str, kind: str, year: int | None = None) -> DataFrame:
    """``read_documents_dir`` for files whose name has the mark ``kind`` ('PV' booklets, 'GB' keys), of one year if given, which is a
    folder or begins the name."""
    files = read_documents_dir(spark, path, f"*{kind}*")
    if year is not None:
        files = files.where(F.col("file_name").startswith(str(year)) | F.col("path").contains(f"/{year}/"))
    return files.orderBy("path")


def read_documents_dir(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Binary files below ``path`` in a stable order, with length, hash and a magic-byte check.

    Columns: path, file_name, length, content_sha256, is_pdf. The content itself is hashed where it is read and
    does not travel further.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "length",
        F.sha2("content", 256).alias("content_sha256"),
        (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"),
    )


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temporary views for use from SQL."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
