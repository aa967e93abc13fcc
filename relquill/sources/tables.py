"""Scans and sinks: the driver's tables, JSON lines, wide JSON, vectors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows (texts) of a partition that ``parts`` counts with, about.
PART_ROWS = 5_000


def parts(df: DataFrame, size: int = PART_ROWS) -> int:
    """How many partitions hold ``size`` rows of ``df`` each, one for each core at least; so a task doesn't grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // size))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan of few files over all cores, in partitions of bounded rows; with as many files as those the scan stays as it is."""
    n = parts(df)
    return df.repartition(n) if len(df.inputFiles()) < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset and all is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="relquill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that it is computed once; deleted when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines split at line feeds alone, so that other separators may stand inside strings."""
    reader = spark.read.option("lineSep", "\n")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json_lines(df: DataFrame, path: str, nulls: bool = True) -> None:
    """JSON lines with sorted keys; nulls are kept unless not ``nulls``."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false" if nulls else "true"})
    df.select(row.alias("value")).write.option("lineSep", "\n").text(path)


def located_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the non-blank lines of each file with their numbers, for findings."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = text.select("file", F.posexplode(F.split("value", "\n")).alias("k", "value"))
    return lines.where(F.trim("value") != "").select("file", (F.col("k") + 1).alias("line"), F.trim("value").alias("value"))


def long_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(node, dim, x): one row for each component."""
    return df.select(F.col(id_col).alias("node"), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


#: JSON files that hold no records (splits, results, snapshots).
NO_RECORDS = ("split.json", "ablation-results.json", "diff2test-cochange.json")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path): the JSON and JSON-lines files below ``root``, without templates, results and other files that hold no records."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl}").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~F.col("path").contains("/templates/") & ~name.isin(*NO_RECORDS) & ~name.endswith("-results.json"))


def located_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, at, location, value): each JSON object with its place ``at`` in its file, and ``file:line`` in JSON lines, ``file[i]``
    in an array and ``file`` alone else.

    The value is a variant; null where a line or file is no JSON.
    """
    if not paths:
        return spark.createDataFrame([], "path string, at int, location string, value string").withColumn("value", F.try_parse_json("value"))
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")
    lines = text.where(F.col("file").endswith(".jsonl")).select("path", "file", F.posexplode(F.split("value", "\n")).alias("at", "line")).where(F.trim("line") != "")
    out = lines.select("path", "at", F.concat_ws(":", "file", F.col("at") + 1).alias("location"), F.try_parse_json("line").alias("value"))
    whole = text.where(~F.col("file").endswith(".jsonl")).select("path", "file", F.try_parse_json("value").alias("value"))
    array = F.try_variant_get("value", "$", "array<variant>")
    single = whole.where(array.isNull()).select("path", F.lit(0).alias("at"), F.col("file").alias("location"), "value")
    many = whole.where(array.isNotNull()).select("path", "file", F.posexplode(array).alias("at", "value")).select("path", "at", F.concat("file", F.lit("["), "at", F.lit("]")).alias("location"), "value")
    return out.union(single).union(many)


def located_objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(location, value) of ``located_rows``."""
    return located_rows(spark, paths).select("location", "value")


def load_snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row of ``schema`` from ``snapshot.json``, or from ``meta.json`` and the separate files of its parts, where they are."""
    store = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = lambda name: store(name).getFileSystem(spark._jsc.hadoopConfiguration()).exists(store(name))
    text = lambda name: spark.read.text(f"{folder}/{name}", wholetext=True)
    if there("snapshot.json"):
        return text("snapshot.json").select(F.from_json("value", schema).alias("s")).select("s.*")
    if not there("meta.json"):
        raise FileNotFoundError(f"neither snapshot.json nor meta.json in {folder}")
    out = text("meta.json").select(F.from_json("value", schema).alias("s")).select("s.*")
    for field in out.schema.fields:
        if there(f"{field.name}.json"):
            part = text(f"{field.name}.json").select(F.from_json("value", field.dataType).alias(field.name))
            out = out.drop(field.name).join(F.broadcast(part))  # one row each
    return out.select(*(f.name for f in T._parse_datatype_string(schema).fields))


def write_json(obj: object, path: str) -> None:
    """An indented JSON document of a bounded result (a card, a report), written by the driver."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")


def ragged(df: DataFrame, ids: str, offsets: str, values: str) -> DataFrame:
    """(id, chunk_ix, value): rows of compressed sparse form, where entry k of ``ids`` owns values offsets[k] to offsets[k + 1]."""
    own = F.transform(ids, lambda i, k: F.struct(i.alias("id"), F.slice(values, F.get(offsets, k) + 1, F.get(offsets, k + 1) - F.get(offsets, k)).alias("v")))
    return df.select(F.explode(own).alias("x")).select("x.id", F.posexplode("x.v").alias("chunk_ix", "value"))


def read_npz(spark: SparkSession, path: str, ids: str = "ids", vectors: str = "vectors", offsets: str | None = None) -> DataFrame:
    """(id, v), or (id, chunk_ix, v) with ``offsets``: vectors from numpy archives, one task a file; the file is read by Spark."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for raw in batch["content"]:
                with np.load(io.BytesIO(raw)) as f:
                    names, v = f[ids].astype(str), f[vectors].astype(float)
                    ends = f[offsets] if offsets else np.arange(len(names) + 1)
                count = np.diff(ends)
                chunk = np.arange(len(v)) - np.repeat(ends[:-1], count)
                yield pd.DataFrame({"id": np.repeat(names, count), "chunk_ix": chunk.astype("int32"), "v": list(v)})

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string, chunk_ix int, v array<double>")
    return out if offsets else out.drop("chunk_ix")


def merge_new(df: DataFrame, path: str, keys: list[str], done: DataFrame | None = None, unit: str | None = None) -> int:
    """Append to the table at ``path`` the rows whose keys it lacks, leaving out units (such as repositories) that ``done`` lists.

    Repeating a build adds nothing, so one that was interrupted may be run again. Gives the number of rows added.
    """
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if done is not None and unit is not None:
        new = new.join(done.select(unit).distinct(), unit, "left_anti").select(*df.columns)
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti").select(*df.columns)
    held = materialise(new, "new")
    held.write.mode("append").parquet(path)
    return held.count()
