"""Files as rows: content, hash, place in the content-addressed store; tables out as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPLOAD_BYTES = 25 << 20


def scan(spark: SparkSession, path: str, most: int = UPLOAD_BYTES) -> DataFrame:
    """Files below a path, up to a size: filename, length, content, file_hash_sha256. Spark reads no row from an empty file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content", F.sha2("content", 256).alias("file_hash_sha256"))


def rejected(spark: SparkSession, path: str, most: int = UPLOAD_BYTES) -> DataFrame:
    """Files below a path that are too large to be taken in: filename, length, code. Only their names and sizes are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") > most)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.lit("FILE_TOO_LARGE").alias("code"))


def dataset_catalog(spark: SparkSession, path: str, datasets: DataFrame) -> DataFrame:
    """Datasets (key, dir, name, category, description) with the number of files in each folder below `path`, hidden ones aside; 0 without any."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -2).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("file"))
    counted = found.where(~F.startswith("file", F.lit("."))).groupBy("dir").agg(F.count(F.lit(1)).alias("count"))
    return datasets.join(counted, "dir", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def store_path(sha: Column, prefix: str, extension: str) -> Column:
    """Where the store keeps a content: two levels of the hash, then the hash."""
    return F.concat_ws("/", F.lit(prefix), F.substring(sha, 1, 2), F.substring(sha, 3, 2), F.concat(sha, F.lit(extension)))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash is not among the known ones, each content once."""
    return found.dropDuplicates(["file_hash_sha256"]).join(known.select("file_hash_sha256"), "file_hash_sha256", "left_anti")


def export_csv(rows: DataFrame, path: str, doc_type: str | None = None) -> None:
    """Rows, of one document type if given, as quoted CSV with a header."""
    (rows if doc_type is None else rows.where(F.col("doc_type") == doc_type)).write.option("header", True).option("quoteAll", True).csv(path)
