"""Reading and writing traces, results and parameters."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's format by file suffix.
FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "orc": "orc", "txt": "text"}


def read_any(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Reads a file or folder by its suffix or the given kind; ``source_file`` tells where each row is from."""
    name = kind or path.rstrip("/*").rpartition(".")[2].lower()
    if name not in FORMATS:
        raise ValueError(f"no reader for {name!r}")
    reader = spark.read.format(FORMATS[name]).option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    reader = reader.option("header", True) if name == "csv" else reader
    reader = reader.schema(schema) if schema else reader
    return reader.load(path).withColumn("source_file", F.input_file_name())


def pack(traces: DataFrame, keys: list[str], n: str = "n", x: str = "x") -> DataFrame:
    """One row for each trace with its samples in order."""
    return traces.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(n, x))), lambda s: s[x]).alias(x))


def unpack(packed: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    return packed.select(*keys, F.posexplode(x).alias("n", x)).withColumn("n", F.col("n").cast("long"))


def chunked(traces: DataFrame, length: int, n: str = "n") -> DataFrame:
    """Adds ``chunk_id`` for pieces of ``length`` samples."""
    return traces.withColumn("chunk_id", F.floor(F.col(n) / length).cast("long"))


def one_step(headers: DataFrame) -> float:
    """The sampling step that all headers share; ValueError if there are several."""
    rows = headers.select("delta").distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError("traces of one job must have one sampling step")
    return float(rows[0][0])


def save(relations: Mapping[str, DataFrame], path: str, params: Mapping | None = None, partition_by: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Each relation as a Parquet folder of its name, and the parameters as JSON."""
    for name, df in relations.items():
        spark = df.sparkSession
        (df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")).parquet(f"{path}/{name}")
    if params is not None and spark is not None:
        spark.createDataFrame([(json.dumps(dict(params), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_params")


def load(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    """The relations and parameters that ``save`` wrote."""
    params = json.loads("".join(r[0] for r in spark.read.text(f"{path}/_params").collect()))
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, params


def export_events(cutouts: DataFrame, keys: list[str], path: str) -> None:
    """One folder for each event cut-out, named by its trace and interval."""
    cutouts.write.mode("overwrite").partitionBy(*keys, "interval_id").parquet(path)
