"""Reading the tables and shared folders the corpus queries use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (tests) gets a new local folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: later stages no longer depend on lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """The rows in the shared folder as a table of buckets of ``key``: grouping it by the key needs no shuffle."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    named = "held_" + uuid.uuid4().hex
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(named)
    return spark.table(named)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows with texts go to Python in Arrow batches of at most ``rows``, so a batch's memory stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text only, so that extra columns of any name cannot clash with working columns; in bounded batches."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def salted_join(big: DataFrame, few: DataFrame, key: str, weight: str, total: int, spread: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """``big`` joined on ``key`` to ``few``, which has a row a key and says in ``weight`` how many rows of ``big`` hold it.

    Keys with over a thousandth of the ``total`` rows (so at most a thousand keys, which are broadcast) are dealt over
    ``salts`` parts by the columns ``spread``; their rows of ``few`` are repeated.
    """
    limit = max(1000, total // 1000)
    hot = F.broadcast(few.where(F.col(weight) > limit).select(key, F.lit(True).alias("__hot")))
    left = big.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0))
    right = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > limit, salts - 1).otherwise(0))))
    return left.join(right, [key, "__salt"], how).drop("__hot", "__salt")
