"""Reading documents from files: binary with hashes, whole texts, CSV sheets; one row for each file, never an exception for one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by extension (fixed values).
FORMATS = {"pdf": ("pdf",), "excel": ("xlsx", "xls", "csv"), "word": ("docx", "doc"), "image": ("png", "jpg", "jpeg", "tiff", "tif", "bmp"), "text": ("txt", "md", "text")}


def document_format(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("other")
    for name, values in FORMATS.items():
        out = F.when(extension.isin(*values), name).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """path, modified, length, content, file_hash (SHA-256), format of every file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return df.select("path", F.col("modificationTime").alias("modified"), "length", "content", F.sha2("content", 256).alias("file_hash"), document_format(F.col("path")).alias("format"))


def texts(files: DataFrame) -> DataFrame:
    """Text files with their content as text; bytes that are no UTF-8 become replacement characters."""
    return files.filter("format = 'text'").select("path", "file_hash", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; columns as text."""
    return spark.read.option("header", True).option("multiLine", True).csv(path)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The first path of each hash that isn't known yet."""
    first = files.groupBy("file_hash").agg(F.min_by(F.struct(*(c for c in files.columns if c != "file_hash")), "path").alias("f")).select("file_hash", "f.*")
    return first.join(known.select("file_hash"), "file_hash", "left_anti")
