"""Result sinks: partitioned Parquet, CSV tables, appended years, and JSON run descriptions."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite", format: str = "parquet", **options: str) -> None:
    """Rows by partition; with dynamic overwrite only the partitions in ``df`` are replaced, so a year can be redone."""
    w = df.write.format(format).mode(mode).option("partitionOverwriteMode", "dynamic").options(**options)
    (w.partitionBy(*partitions) if partitions else w).save(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def append_year(df: DataFrame, path: str) -> None:
    """Add a year's rows: its partition is replaced, other years stay."""
    write_table(df, path, "year")


def signature(config: dict) -> str:
    """SHA-256 of a run's settings in a fixed order of keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def _store(spark: SparkSession, path: str):
    """Hadoop's path, its file system, and the gateway."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place of what was there: readers find the old text or the new one, never a part."""
    at, store, jvm = _store(spark, path)
    part, _, _ = _store(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(part, at, options)


def write_metadata(spark: SparkSession, path: str, config: dict, **more) -> str:
    """The settings, their signature and further entries as ``path``/manifest.json; returns the signature."""
    name = signature(config)
    publish(spark, f"{path}/manifest.json", json.dumps(config | more | {"signature": name}, sort_keys=True, default=str))
    return name


def manifest(spark: SparkSession, path: str) -> dict:
    """What write_metadata wrote there last, or nothing."""
    at, store, _ = _store(spark, f"{path}/manifest.json")
    if not store.exists(at):
        return {}
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))  # a line or a few


def read_metadata(spark: SparkSession, path: str, config: dict) -> dict | None:
    """What write_metadata wrote there under the same settings, or None."""
    held = manifest(spark, path)
    return held if held.get("signature") == signature(config) else None


def read_checkpoint(spark: SparkSession, path: str, config: dict) -> DataFrame | None:
    """The table of an earlier run with the same settings, or None."""
    held = read_metadata(spark, path, config)
    return None if held is None else spark.read.parquet(f"{path}/{held['rows']}")


def write_report(spark: SparkSession, path: str, tables: dict[str, DataFrame], rows: int = 50) -> None:
    """A text report: each table's heading and its first ``rows`` rows, in the order given."""
    lines = []
    for title, df in tables.items():
        lines += [title, "-" * len(title), " | ".join(df.columns)]
        lines += [" | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.take(rows)]
        lines.append("")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def checkpointed(df: DataFrame | Callable[[], DataFrame], path: str, config: dict, spark: SparkSession | None = None) -> DataFrame:
    """Rows of the generation in ``path`` that was made under the same settings; else they are made, as a new generation.

    ``df`` may be a function that makes the rows, which is not called where they are there.  A generation is a folder of its
    own that the manifest names once it is whole: a run that dies leaves the last one as it was, and readers of that one are
    not disturbed.  The generation before the last goes when a new one is published.
    """
    spark = spark or df.sparkSession
    found = read_checkpoint(spark, path, config)
    if found is not None:
        return found
    before, own = manifest(spark, path), f"rows-{uuid.uuid4().hex}"
    write_table(df if isinstance(df, DataFrame) else df(), f"{path}/{own}")
    write_metadata(spark, path, config, rows=own, before=before.get("rows"))
    if before.get("before"):
        at, store, _ = _store(spark, f"{path}/{before['before']}")
        store.delete(at, True)
    return spark.read.parquet(f"{path}/{own}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's spark.checkpoint.dir, which driver and executors share (a local session may lack it)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: what reads them several times makes them once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
