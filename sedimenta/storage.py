"""Paths of any file system that Spark reaches: small text files, listings, existence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Schemes of the stores that paths may name; how each is reached is Hadoop's configuration.
SCHEMES = ("file", "hdfs", "viewfs", "s3a", "s3", "gs", "abfs", "abfss", "wasbs", "http", "https")


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _path(spark, uri)
    return fs.exists(path)


def read_text(spark: SparkSession, uri: str) -> str | None:
    """A small file's text, None if there is none."""
    fs, path = _path(spark, uri)
    if not fs.exists(path):
        return None
    f = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    fs, path = _path(spark, uri)
    f = fs.create(path, True)
    try:
        f.write(bytearray(text.encode()))
    finally:
        f.close()


def children(spark: SparkSession, uri: str) -> list[str]:
    """Names of the directories in a directory, sorted."""
    fs, path = _path(spark, uri)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def objects(spark: SparkSession, uri: str) -> DataFrame:
    """(path, bytes) of every file below a directory, listed by Spark's tasks without reading the files."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(uri)
        .selectExpr("path", "length AS bytes")
    )


def check(spark: SparkSession, uri: str, first: int = 10) -> dict:
    """Number and bytes of a store's objects, and the first few paths."""
    found = objects(spark, uri)
    t = found.selectExpr("count(*) AS n", "coalesce(sum(bytes), 0) AS bytes").first()
    return {"objects": t["n"], "bytes": t["bytes"], "first": [r["path"] for r in found.orderBy("path").limit(first).collect()]}


def summarize(spark: SparkSession, uri: str) -> DataFrame:
    """(prefix, objects, bytes): what lies under each directory next to the root."""
    fs, path = _path(spark, uri)
    root = fs.makeQualified(path).toUri().getPath().rstrip("/")
    tail = f"regexp_replace(path, '^.*?{root}/', '')"
    return (
        objects(spark, uri)
        .selectExpr(f"CASE WHEN instr({tail}, '/') > 0 THEN split_part({tail}, '/', 1) ELSE '' END AS prefix", "bytes")
        .groupBy("prefix")
        .agg({"*": "count", "bytes": "sum"})
        .selectExpr("prefix", "`count(1)` AS objects", "`sum(bytes)` AS bytes")
    )


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share; only where none is named, a temporary one."""
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"
